"""Tokens and the vault: numbering, substitution, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.operators.classify import first_per_selector
from veilspark.operators.ranking import numbered

STEP_BUCKET = 1024  # steps per numbering bucket


def attach_detection(classified: DataFrame, page: list[str]) -> DataFrame:
    """Add ``hit``: the first tokenisable detection on the element's selector."""
    own = F.when(F.col("det.token_kind").isNotNull(), F.col("det"))
    hit = F.first(own, ignorenulls=True).over(first_per_selector(page))
    usable = F.coalesce(F.col("selector"), F.lit("")) != ""
    return classified.withColumn("hit", F.when(usable, hit))


def tokens(tagged: DataFrame, session: str = "session_id", step: str = "step") -> DataFrame:
    """Sensitive elements with their token ``[KIND_n]``.

    n counts all sensitive elements of the kind in the session, empty ones
    included, in (step, page_id, pos) order, which no two elements share.  Numbering is two-level, so a session that
    holds a large share of all rows is still spread over many tasks.
    """
    sensitive = tagged.filter(F.col("hit").isNotNull()).withColumn("kind", F.col("hit.token_kind"))
    ranked = numbered(
        sensitive, [session, "kind"], F.floor(F.col(step) / STEP_BUCKET), [step, "page_id", "pos"], "seq"
    )
    return ranked.withColumn(
        "token", F.concat(F.lit("["), "kind", F.lit("_"), F.col("seq").cast("string"), F.lit("]"))
    )


def vault_rows(tokenised: DataFrame, session: str = "session_id") -> DataFrame:
    """Token to raw value; empty fields have a token but no row here."""
    return tokenised.filter(F.coalesce(F.col("value"), F.lit("")) != "").select(
        session, "token", "kind", "seq", F.col("value").alias("raw_value")
    )


def sanitised_elements(tagged: DataFrame, tokenised: DataFrame) -> DataFrame:
    """Elements for transport: token for sensitive fields, PII-shaped values of
    other fields wiped, placeholder and vault columns dropped."""
    columns = [c for c in tagged.columns if c not in ("placeholder", "det", "hit")]
    hidden = tokenised.select(*[F.col("token").alias("value") if c == "value" else F.col(c) for c in columns])
    plain = tagged.filter(F.col("hit").isNull()).withColumn(
        "value", F.when(P.has_finding(F.col("value")), F.lit("")).otherwise(F.col("value"))
    )
    return hidden.unionByName(plain.select(*columns))


def well_formed_token_count(value: Column) -> Column:
    return F.count_if(P.is_token(value))


def resolve_tokens(requests: DataFrame, vault: DataFrame, defaults: DataFrame, session: str = "session_id") -> DataFrame:
    """Resolve ``value`` of each request: vault, exact default, first default that
    begins with the token's kind and an underscore, else NULL; a literal passes through.

    ``defaults`` has (token_name, raw_value) with the order ``ord``; it is a
    fixed table of one row per token kind.
    """
    trimmed = F.trim("value")
    is_tok = P.is_token(trimmed)
    name = F.regexp_replace(trimmed, r"[\[\]]", "")
    base = F.regexp_replace(name, r"_\d+$", "")
    exact = defaults.select(F.col("token_name").alias("_name"), F.col("raw_value").alias("_exact"))
    # A name of k parts answers to each of its k - 1 beginnings.
    parts = F.split("token_name", "_")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    by_kind = (
        defaults.where(F.size(parts) > 1).select("raw_value", "ord", F.explode(begins).alias("_base"))
        .groupBy("_base").agg(F.min_by("raw_value", "ord").alias("_by_kind"))
    )
    asked = requests.withColumns(
        {
            "_tok": F.when(is_tok, trimmed),
            "_name": F.when(is_tok, name),
            "_base": F.when(is_tok, base),
        }
    )
    known = vault.select(session, F.col("token").alias("_tok"), F.col("raw_value").alias("_raw"))
    return (
        asked.join(known, [session, "_tok"], "left")
        .join(exact, "_name", "left")
        .join(by_kind, "_base", "left")
        .withColumn(
            "resolved",
            F.when(F.col("_tok").isNull(), F.col("value")).otherwise(F.coalesce("_raw", "_exact", "_by_kind")),
        )
        .drop("_tok", "_name", "_base", "_raw", "_exact", "_by_kind")
    )


def known_tokens(requests: DataFrame, vault: DataFrame, defaults: DataFrame, session: str = "session_id") -> DataFrame:
    """Requests whose token exists in the session's vault or in the defaults."""
    held = vault.select(session, F.col("token").alias("value"), F.lit(True).alias("_held")).distinct()
    names = defaults.select(F.col("token_name").alias("_name"), F.lit(True).alias("_named")).distinct()
    return (
        requests.withColumn("_name", F.regexp_replace("value", r"[\[\]]", ""))
        .join(names, "_name", "left").join(held, [session, "value"], "left")
        .where(F.col("_held") | F.col("_named")).select(*requests.columns)
    )

"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.operators import scan as S
from veilspark.operators.containment import containment
from veilspark.plans import sqlparts as Q
from veilspark.plans.derived import load
from veilspark.plans.registry import query
from veilspark.session import spread
from veilspark.sources import html as H


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


@query(
    "pii_counts_by_lang",
    f"""WITH f AS ({Q.findings('documents', 'text', 'doc_id', 'lang')})
    SELECT lang, pii_type, count(*) AS findings, count(DISTINCT doc_id) AS affected FROM f GROUP BY ALL""",
)
def pii_counts_by_lang(spark, sf_dir):
    return S.counts_by(documents(spark, sf_dir, "text", "lang"), "text", "lang")


@query(
    "pii_findings",
    f"""SELECT doc_id, pos, pii_type, md5(value) AS value_md5, length(value) AS n
    FROM ({Q.findings('documents', 'text', 'doc_id')})""",
)
def pii_findings(spark, sf_dir):
    found = S.exploded_findings(documents(spark, sf_dir, "text"), "text", "doc_id")
    return found.select("doc_id", "pos", "pii_type", F.md5("value").alias("value_md5"), F.length("value").alias("n"))


@query(
    "card_luhn_split",
    f"""SELECT lang, source, count(*) AS candidates, count(*) FILTER (WHERE {Q.luhn('v')}) AS valid,
           count(*) FILTER (WHERE NOT {Q.luhn('v')}) AS invalid
    FROM (SELECT lang, source, unnest(regexp_extract_all(text, {Q.PATTERN['credit_card']})) AS v FROM documents)
    GROUP BY ALL""",
)
def card_luhn_split(spark, sf_dir):
    text = F.col("text")
    found = F.when(
        F.rlike(text, F.lit(P.NUMERIC_GUARD)),
        F.regexp_extract_all(text, F.lit(P.TEXT_REGEX["credit_card"]), F.lit(0)),
    ).otherwise(F.array().cast("array<string>"))
    per_doc = documents(spark, sf_dir, "text", "lang", "source").select("lang", "source", found.alias("c"))
    counted = per_doc.select(
        "lang", "source", F.size("c").alias("n"), F.size(F.filter("c", P.luhn_ok)).alias("ok")
    )
    return (
        counted.groupBy("lang", "source")
        .agg(F.sum("n").alias("candidates"), F.sum("ok").alias("valid"))
        .filter(F.col("candidates") > 0)
        .withColumn("invalid", F.col("candidates") - F.col("valid"))
    )


@query(
    "conversation_pii",
    f"""WITH c AS (SELECT conv_id, turn, role, {Q.scan('text')} AS f FROM conversations)
    SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS sessions, sum(len(f)) AS findings FROM c GROUP BY role""",
)
def conversation_pii(spark, sf_dir):
    turns = spread(load(spark, sf_dir, "conversations"), "conv_id", "turn")
    per_session = (
        turns.select("conv_id", "role", F.size(P.scan_text(F.col("text"))).alias("n"))
        .groupBy("role", "conv_id")
        .agg(F.count("*").alias("t"), F.sum("n").alias("f"))
    )
    return per_session.groupBy("role").agg(
        F.sum("t").alias("turns"), F.count("*").alias("sessions"), F.sum("f").alias("findings")
    )


@query("redact_documents", f"SELECT doc_id, md5({Q.redacted('text')}) AS redacted_md5 FROM documents")
def redact_documents(spark, sf_dir):
    done = P.redact_text(documents(spark, sf_dir, "text"), "text", "redacted")
    return done.select("doc_id", F.md5("redacted").alias("redacted_md5"))


@query(
    "masked_hints",
    f"""SELECT pii_type, {Q.audit_hint('pii_type', 'value')} AS hint, count(*) AS n
    FROM ({Q.findings('documents', 'text', 'doc_id')}) GROUP BY ALL""",
)
def masked_hints(spark, sf_dir):
    found = S.exploded_findings(documents(spark, sf_dir, "text"), "text", "doc_id")
    return found.groupBy("pii_type", P.audit_hint(F.col("pii_type"), F.col("value")).alias("hint")).agg(
        F.count("*").alias("n")
    )


@query(
    "doc_compliance",
    f"""SELECT doc_id, len({Q.scan('text')}) AS violations, len({Q.scan('text')}) = 0 AS compliant,
           coalesce(list_aggregate(list_sort(list_distinct(list_transform({Q.scan('text')}, lambda y: y.type))),
                    'string_agg', ','), '') AS classes
    FROM documents""",
)
def doc_compliance(spark, sf_dir):
    scanned = S.with_findings(documents(spark, sf_dir, "text"), "text")
    classes = F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["type"])))
    return scanned.select(
        "doc_id",
        F.size("findings").alias("violations"),
        (F.size("findings") == 0).alias("compliant"),
        F.array_join(classes, ",").alias("classes"),
    )


@query(
    "quality_vs_pii",
    f"""WITH d AS (SELECT doc_id, lang, {Q.has_finding('text')} AS reported FROM documents),
    j AS (SELECT coalesce(lang, '?') AS lang, coalesce(reported, false) AS reported, (quality = 0 OR toxic = 1) AS expected
          FROM labels LEFT JOIN d USING (doc_id)),
    c AS (SELECT lang, count(*) FILTER (WHERE expected AND reported) AS tp,
                 count(*) FILTER (WHERE NOT expected AND reported) AS fp,
                 count(*) FILTER (WHERE expected AND NOT reported) AS fn FROM j GROUP BY ROLLUP (lang))
    SELECT coalesce(lang, 'total') AS lang, tp, fp, fn, tp / greatest(1, tp + fp) AS precision,
           tp / greatest(1, tp + fn) AS recall FROM c""",
)
def quality_vs_pii(spark, sf_dir):
    flagged = documents(spark, sf_dir, "text", "lang").select(
        "doc_id", "lang", P.has_finding(F.col("text")).alias("reported")
    )
    judged = (
        load(spark, sf_dir, "labels")
        .select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("expected"))
        .join(flagged, "doc_id", "left")
        .select(
            F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("reported", F.lit(False)).alias("reported"),
            "expected",
        )
    )
    e, r = F.col("expected"), F.col("reported")
    counted = judged.rollup("lang").agg(
        F.count_if(e & r).alias("tp"), F.count_if(~e & r).alias("fp"), F.count_if(e & ~r).alias("fn")
    )
    one = F.lit(1)
    return counted.select(
        F.coalesce("lang", F.lit("total")).alias("lang"), "tp", "fp", "fn",
        (F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))).alias("recall"),
    )


@query(
    "benchmark_containment",
    """SELECT doc_id, item_id, concat(substr(b.text, 1, 2), '***') AS hint
    FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) >= 4""",
)
def benchmark_containment(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("protected"))
    pairs = containment(documents(spark, sf_dir, "text"), ["doc_id"], "text", items, ["item_id"], "protected")
    return pairs.select("doc_id", "item_id", P.masked(F.col("protected"), 2).alias("hint"))


def _sql_unescape(e: str) -> str:
    for entity, char in H._ENTITIES:
        e = f"replace({e}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return e


@query(
    "page_hidden_pii",
    rf"""WITH t AS (SELECT page_id, array_to_string(regexp_extract_all(concat(html, '<!-- ask u', page_id, '@example.com --><script>var n = "987-65-4321";</script>'),
            '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>'), ' ') AS body FROM pages)
    SELECT page_id, pos, pii_type, concat(substr(value, 1, 3), '***') AS hint FROM ({Q.findings('t', 'body', 'page_id')})""",
)
def page_hidden_pii(spark, sf_dir):
    """Findings in what a page does not show: comments, scripts and styles; one of each kind of place is appended."""
    pages = spread(load(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    planted = F.concat("html", F.lit("<!-- ask u"), "page_id", F.lit('@example.com --><script>var n = "987-65-4321";</script>'))
    hidden = F.regexp_extract_all(planted, F.lit(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"), F.lit(0))
    found = S.exploded_findings(pages.select("page_id", F.array_join(hidden, " ").alias("body")), "body", "page_id")
    return found.select("page_id", "pos", "pii_type", P.masked(F.col("value"), 3).alias("hint"))


@query(
    "page_pii",
    f"""WITH c AS (SELECT page_id, regexp_replace(html,
                     '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g') AS h FROM pages),
    t AS (SELECT page_id, {_sql_unescape("""concat(regexp_replace(h, '<[^>]*>', ' ', 'g'), ' ',
                     array_to_string(regexp_extract_all(h, '=\\s*"([^"]*)"', 1), ' '))""")} AS body FROM c)
    SELECT page_id, len({Q.scan('body')}) AS findings, length(body) AS n_chars FROM t""",
)
def page_pii(spark, sf_dir):
    """Findings in the text of a page and in the values of its attributes."""
    pages = spread(load(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    no_code = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    values = F.regexp_extract_all("h", F.lit(r'=\s*"([^"]*)"'), F.lit(1))
    # In single quotes or bare, a value counts inside a tag only.
    tags = F.regexp_extract_all("h", F.lit(rf"<[A-Za-z]{H._ATTRS}>"), F.lit(0))
    form = r"""=\s*(?:"[^"]*"|'([^']*)'|([^\s"'>][^\s>]*))"""
    others = F.flatten(F.transform(tags, lambda t: F.concat(
        F.regexp_extract_all(t, F.lit(form), F.lit(1)), F.regexp_extract_all(t, F.lit(form), F.lit(2)))))
    others = F.filter(others, lambda v: v != "")
    # Most pages have neither, and are not taken apart for them.
    others = F.when(F.rlike("h", F.lit(r"""<[A-Za-z][^>]*\s[\w:-]+\s*=\s*[^"\s>]""")), others).otherwise(F.array().cast("array<string>"))
    body = pages.select("page_id", no_code.alias("h")).select(
        "page_id",
        H.unescape(F.concat(
            F.regexp_replace("h", "<[^>]*>", " "), F.lit(" "), F.array_join(values, " "),
            F.when(F.size(others) > 0, F.concat(F.lit(" "), F.array_join(others, " "))).otherwise(""),
        )).alias("body"),
    )
    return body.select("page_id", F.size(P.scan_text(F.col("body"))).alias("findings"), F.length("body").alias("n_chars"))

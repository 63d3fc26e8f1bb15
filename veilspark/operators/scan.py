"""Findings, redaction, leak check and compliance over tables of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import patterns as P

KINDS = tuple(k for k, _ in fixed.TEXT_PATTERNS)


def with_findings(df: DataFrame, column: str, output: str = "findings") -> DataFrame:
    return df.withColumn(output, P.scan_text(F.col(column)))


def exploded_findings(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per finding: kept columns, position, type, value.

    The outer form is used on purpose: for the inner form the optimizer adds a
    size filter below the generator, which would run the patterns twice.
    """
    return (
        df.select(*keep, P.scan_text(F.col(column)).alias("_f"))
        .select(*keep, F.posexplode_outer("_f").alias("pos", "_x"))
        .filter(F.col("_x").isNotNull())
        .select(*keep, "pos", F.col("_x.type").alias("pii_type"), F.col("_x.value").alias("value"))
    )


def counts_by(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Findings and affected rows per key and class, in one partial aggregation.

    Each row contributes one number per class, so neither the findings nor the
    row ids are shuffled.
    """
    def of_kind(kind: str) -> Column:
        return F.size(F.filter("_f", lambda x: x["type"] == kind)).alias(f"_{kind}")

    per_row = df.select(*keys, P.scan_text(F.col(column)).alias("_f")).select(*keys, *map(of_kind, KINDS))
    aggs = []
    for k in KINDS:
        aggs.append(F.sum(f"_{k}").alias(f"n_{k}"))
        aggs.append(F.count_if(F.col(f"_{k}") > 0).alias(f"d_{k}"))
    wide = per_row.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("pii_type"),
                F.col(f"n_{k}").alias("findings"),
                F.col(f"d_{k}").alias("affected"),
            )
            for k in KINDS
        ]
    )
    return wide.select(*keys, F.inline(rows)).filter(F.col("findings") > 0)


def violations(texts: DataFrame, text: str, where: str, *keep: str) -> DataFrame:
    """Audit findings of (key, where, text) rows with a reason and a masked hint."""
    found = exploded_findings(texts, text, *keep, where)
    return found.select(
        *keep,
        where,
        "pii_type",
        P.lookup(F.col("pii_type"), fixed.AUDIT_REASON).alias("reason"),
        P.audit_hint(F.col("pii_type"), F.col("value")).alias("hint"),
    )


def element_violations(elements: DataFrame, *keep: str) -> DataFrame:
    """Audit of sanitised elements: password rule, then value and text patterns.

    The three checks of one element are gathered in arrays on its own row; only
    the violations leave it.
    """
    name = F.coalesce(F.nullif(F.col("selector"), F.lit("")), F.col("tag"))
    value = F.col("value")
    open_value = value.isNotNull() & ~P.is_token(value)
    row = F.struct
    password = F.when(
        open_value & (F.lower(F.coalesce("type", F.lit(""))) == "password"),
        F.array(row(F.lit(".value").alias("part"), F.lit("password").alias("type"), value.alias("value"))),
    ).otherwise(F.array().cast("array<struct<part:string,type:string,value:string>>"))

    def part(label: str, findings: Column) -> Column:
        return F.transform(
            findings,
            lambda x: row(F.lit(label).alias("part"), x["type"].alias("type"), x["value"].alias("value")),
        )

    hits = F.concat(
        password,
        part(".value", P.scan_text(F.when(open_value, value).otherwise(""))),
        part(".text", P.scan_text(F.coalesce("text", F.lit("")))),
    )
    return (
        elements.select(*keep, name.alias("_name"), hits.alias("_h"))
        .select(*keep, "_name", F.explode_outer("_h").alias("_x"))
        .filter(F.col("_x").isNotNull())
        .select(
            *keep,
            F.concat(F.lit("dom_elements["), "_name", F.lit("]"), F.col("_x.part")).alias("where"),
            F.col("_x.type").alias("pii_type"),
            P.lookup(F.col("_x.type"), fixed.AUDIT_REASON).alias("reason"),
            P.audit_hint(F.col("_x.type"), F.col("_x.value")).alias("hint"),
        )
    )


def compliance(payloads: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdict per payload; payloads without a violation appear with zero."""
    totals = found.groupBy(*keys).agg(F.count("*").alias("violations"))
    return (
        payloads.join(totals, list(keys), "left")
        .withColumn("violations", F.coalesce("violations", F.lit(0).cast("long")))
        .withColumn("compliant", F.col("violations") == 0)
    )


def pattern_leaks(payloads: DataFrame, text: str, keys: Sequence[str], allow: DataFrame | None = None) -> DataFrame:
    """Pattern findings outside tokens, minus an allow-list of values."""
    stripped = payloads.select(*keys, P.strip_tokens(F.col(text)).alias("_text"))
    found = exploded_findings(stripped, "_text", *keys)
    if allow is not None:
        found = found.join(allow.select(F.col("value")).distinct(), "value", "left_anti")
    return found.select(
        *keys,
        F.lit("PII pattern in payload").alias("reason"),
        "pii_type",
        P.masked(F.col("value"), 3).alias("hint"),
    )

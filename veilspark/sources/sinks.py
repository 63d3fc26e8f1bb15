"""Writers.  Raw values never leave through these: vault columns are refused."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIVATE_COLUMNS = ("raw_value", "placeholder", "det", "hit")
LOG_BUCKETS = 64


def safe_session(session: Column) -> Column:
    return F.regexp_replace(session, r"[^\w-]", "_")


def write_payload_log(payloads: DataFrame, path: str, session: str = "session_id", buckets: int = LOG_BUCKETS, run: str = "0") -> None:
    """One JSON record per (session, step), laid out by a hash of session and step.

    A folder per session would give one folder per key, and one huge folder for
    a busy session; the fixed number of hash folders does neither.  Each ``run``
    has a folder of its own, which a repeated run overwrites.
    """
    _refuse_private(payloads)
    named = payloads.withColumn(session, safe_session(F.col(session).cast("string")))
    bucket = F.pmod(F.xxhash64(session, "step_index"), F.lit(buckets))
    rows = named.withColumn("bucket", bucket).repartition(buckets, "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").json(f"{path}/run={run}")


def write_results(tables: Mapping[str, DataFrame], path: str) -> None:
    """One parquet folder per result table (context, detections, applied, verdicts, timings)."""
    for name, df in tables.items():
        _refuse_private(df)
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_sanitised(elements: DataFrame, path: str) -> None:
    _refuse_private(elements)
    elements.write.mode("overwrite").parquet(path)


def write_vault(vault: DataFrame, path: str) -> None:
    """The vault has its own path; keep its access rights apart from the outputs."""
    vault.write.mode("overwrite").parquet(path)


def _refuse_private(df: DataFrame) -> None:
    found = [c for c in df.columns if c in PRIVATE_COLUMNS]
    if found:
        raise ValueError(f"vault-side columns in an outgoing table: {found}")

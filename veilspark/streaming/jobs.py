"""Structured Streaming jobs: sanitising, whole steps, telemetry, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark import fixed
from veilspark.functions import patterns as P
from veilspark.operators import classify as C
from veilspark.operators import flow as W
from veilspark.operators import quality as K
from veilspark.operators import sessions as T
from veilspark.session import grows, materialise, scratch, shared_dir, tasks
from veilspark.streaming import vaults as S

FILES_PER_BATCH = 64


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The files of a table as a stream, oldest first, so many of them to a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # As a pattern it may stand for a folder or for a single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def run_available(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append", progress: str | None = None
) -> None:
    """Process everything that is there, micro-batch by micro-batch, and stop."""
    spark = stream.sparkSession
    q: StreamingQuery = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", progress or shared_dir(spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


# ---------------------------------------------------------------------------
def sanitise(records: DataFrame, text: str, session: str, step: str) -> DataFrame:
    """Redacted text and a status; a record that is invalid or that still shows a
    finding after redaction is blocked.  Texts may have any length but none.  Works
    on batch and streaming frames."""
    done = P.redact_text(records, text, "clean_text")
    valid = K.record_is_valid(F.col(text), F.col(session).cast("string"), F.col(step))
    leak_free = ~P.has_finding(P.strip_tokens(F.col("clean_text")))
    status = F.when(~valid, "invalid").when(~leak_free, "leak").otherwise("clean")
    return done.withColumn("status", status).drop(text)


def sanitise_sink(out: str) -> Callable[[DataFrame, int], None]:
    """Records by status, clean and blocked ones in folders of their own; a repeated
    batch overwrites its own folder.  Blocked records keep no text."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.withColumn("clean_text", F.when(F.col("status") == "clean", F.col("clean_text")))
        kept.write.mode("overwrite").partitionBy("status").parquet(f"{out}/batch={batch_id}")

    return handle


# ---------------------------------------------------------------------------
STEP_STATES = ("unverified image", "vault leak", "pattern leak", "invalid", "sent")
_PAGE_KEYS = ["session_id", "page_id", "step"]


_CARRIED = (
    *_PAGE_KEYS, "task", "verified", "pos", "tag", "type", "id", "name", "selector", "text", "label", "aria_label", "autocomplete", "role", "value",
)


def step_stream(elements: DataFrame) -> DataFrame:
    """Streaming elements of captured pages (with ``task`` and ``verified``: the verdict on the page's redacted image)
    with the ``token_kind`` of their class. A page's elements must arrive in one micro-batch."""
    found = C.with_detection(elements).withColumn("token_kind", F.col("det.token_kind"))
    return found.select(*_CARRIED, "token_kind")


def step_verdicts(rows: DataFrame, tokenised: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per page: session_id, page_id, step, status, vault_leaks, pattern_leaks, body.

    ``rows``: elements of one micro-batch with their ``kind``; ``tokenised``: those that have one, with their token;
    ``known``: what earlier batches registered. Fail closed: a step is sent only if its image is known to be verified,
    its body shows neither a value of the session's vault nor a personal pattern, and its record is valid.
    """
    # Values of other fields that look personal are wiped; sensitive ones are tokens.
    shown = F.when(P.has_finding(F.col("value")), F.lit("")).otherwise(F.col("value"))
    plain = rows.where(F.col("kind").isNull()).withColumn("value", shown).select(*_CARRIED)
    hidden = tokenised.withColumn("value", F.col("token")).select(*_CARRIED)
    sanitised = hidden.unionByName(plain).withColumns({
        "task": F.coalesce("task", F.lit("")), "verified": F.coalesce("verified", F.lit(False)),
    })
    dealt = sanitised.repartition(tasks(rows, W.ELEMENT_ROWS), "page_id")
    bodies = materialise(P.count_leaks(W.payload_bodies(dealt, F.col("task"), ["task", "verified"]), "body", "pattern_leaks"), "payloads")
    registered = S.registrations(tokenised)
    if known is not None:
        registered = registered.unionByName(known)
    leaks = W.shown_values(bodies, registered.where(F.col("raw_value").isNotNull())).groupBy("page_id").agg(
        F.countDistinct("raw_value").alias("vault_leaks")
    )
    checked = grows(bodies.withColumn("pattern_leaks", F.col("pattern_leaks").cast("long"))).join(grows(leaks), "page_id", "left").withColumn(
        "vault_leaks", F.coalesce("vault_leaks", F.lit(0))
    )
    valid = K.payload_is_valid(F.col("task"), F.col("session_id").cast("string"), F.col("step")) & F.col("page_id").isNotNull()
    status = (
        F.when(~F.col("verified"), "unverified image").when(F.col("vault_leaks") > 0, "vault leak")
        .when(F.col("pattern_leaks") > 0, "pattern leak").when(~valid, "invalid").otherwise("sent")
    )
    return checked.withColumn("status", status).select(
        *_PAGE_KEYS, "status", "vault_leaks", "pattern_leaks", F.when(F.col("status") == "sent", F.col("body")).alias("body")
    )


@contextmanager
def _adaptive(spark: SparkSession) -> Iterator[None]:
    """Spark plans a stream without adaptive execution, for the sake of state operators; the tables of a micro-batch have none."""
    setting = "spark.sql.adaptive.enabled"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, was)


def step_sink(out: str) -> Callable[[DataFrame, int], None]:
    """Payloads that may be sent in one folder, a row for each blocked step in one folder per cause, and the sessions'
    registrations in the folder ``vault``; a repeated batch overwrites its own files. Other copies with raw values are
    gone when the batch is done."""
    vault = S.StepVault(f"{out}/vault")

    def handle(batch: DataFrame, batch_id: int) -> None:
        work, spark = f"{out}/work", batch.sparkSession
        found = S.with_kind(batch).drop("token_kind")
        found.write.mode("overwrite").parquet(work)  # classes are found once only
        with scratch(), _adaptive(spark):
            rows = spark.read.schema(found.schema).parquet(work)
            known = materialise(vault.known(rows, batch_id), "known") if batch_id else None
            tokenised = materialise(S.tokens(rows, known), "tokens")
            step_verdicts(rows, tokenised, known).write.mode("overwrite").partitionBy("status").parquet(f"{out}/steps/batch={batch_id}")
            vault.keep(tokenised, batch_id)
        spark.createDataFrame([], found.schema).write.mode("overwrite").parquet(work)

    return handle


# ---------------------------------------------------------------------------
def window_deltas(steps: DataFrame, width_seconds: int = 3600) -> DataFrame:
    """Latency per window (its ``start``; null for steps without a time) and event type of one micro-batch, in a form
    that adds up with that of any other."""
    width = width_seconds * 1_000_000
    start = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts")) / width) * width)
    return (
        steps.withColumn("total_ms", T.total_ms())
        .groupBy(start.alias("start"), "event_type")
        .agg(
            F.count("*").alias("steps"),
            F.sum("total_ms").alias("sum_ms"),
            F.max("total_ms").alias("worst_ms"),
            F.count_if(F.col("total_ms") > fixed.SLOW_STEP_MS).alias("slow_steps"),
        )
    )


def merged_windows(deltas: DataFrame) -> DataFrame:
    """Windows out of the deltas of all micro-batches, however late a step came."""
    return deltas.groupBy("start", "event_type").agg(
        F.sum("steps").alias("steps"), F.sum("sum_ms").alias("sum_ms"), F.max("worst_ms").alias("worst_ms"),
        F.sum("slow_steps").alias("slow_steps"),
    )


def batch_sink(out: str, reduce: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What ``reduce`` makes of each micro-batch, in a folder of its own that a repeated batch overwrites. Nothing is
    held between batches, so nothing is ever too late."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return handle

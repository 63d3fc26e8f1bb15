"""The vault of a stream of steps: numbering goes on from batch to batch, by plain joins.

A keyed state operator in Python costs a few exchanges with the state store and an Arrow
batch for every session, which for millions of small sessions is nearly all of the time,
and it takes a busy session through one task. Here a micro-batch is numbered like a table
(``ranking.running_total``), from the counts that earlier batches left.

Registrations are kept as Parquet in segments named by the batches that they cover. After
n batches there is one segment for each one-bit of n: a batch puts down its own rows
together with the segments that it completes, so each row is written again at most log2(n)
times and names follow from the batch number alone. A batch writes one segment of its own
and reads only those of batches before it, so a repeated batch gives the same again.
Segments hold raw values: give the folder the access rights of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.operators import vault as V
from veilspark.operators.ranking import running_total
from veilspark.session import delete, grows

_FIRST = -(1 << 62)
"""Bucket of what is numbered before all steps."""


def with_kind(elements: DataFrame) -> DataFrame:
    """Add ``kind``: the first ``token_kind`` on the element's selector within its page."""
    same = Window.partitionBy("session_id", "page_id", "selector").orderBy("step", "pos").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    usable = F.coalesce(F.col("selector"), F.lit("")) != ""
    return elements.withColumn("kind", F.when(usable, F.first("token_kind", ignorenulls=True).over(same)))


def segments(n: int) -> list[tuple[int, int]]:
    """The ranges of batches that hold what the first n batches registered."""
    out, low = [], 0
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            out.append((low, low + (1 << bit)))
            low += 1 << bit
    return out


def _completed(batch_id: int) -> list[tuple[int, int]]:
    """Segments that the one of this batch takes in."""
    n = batch_id + 1
    return [(a, b) for a, b in segments(batch_id) if a >= n - (n & -n)]


class StepVault:
    """Registrations of a stream's steps in a folder: session_id, kind, seq, token, step, pos, raw_value."""

    def __init__(self, folder: str):
        self.folder = folder

    def _read(self, like: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
        schema = _schema(like)
        spark = like.sparkSession
        if not ranges:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[self._at(*x) for x in ranges])

    def _at(self, begin: int, end: int) -> str:
        return f"{self.folder}/{begin}-{end}"

    def known(self, elements: DataFrame, batch_id: int) -> DataFrame:
        """What batches before this one registered for the sessions of ``elements``; a null session is one like any other."""
        held = self._read(elements, segments(batch_id))
        if not batch_id:
            return held
        here = elements.select(F.struct("session_id").alias("_s")).distinct()
        return held.withColumn("_s", F.struct("session_id")).join(grows(here), "_s", "left_semi").drop("_s")

    def keep(self, tokenised: DataFrame, batch_id: int) -> None:
        """Put down what this batch registered. What the batch before has merged is of no more use, as it has ended."""
        own = registrations(tokenised).unionByName(self._read(tokenised, _completed(batch_id)))
        n = batch_id + 1
        own.write.mode("overwrite").parquet(self._at(n - (n & -n), n))
        for old in _completed(batch_id - 1) if batch_id else []:
            delete(self._at(*old))


def _schema(like: DataFrame) -> T.StructType:
    held = [T.StructField(c, like.schema[c].dataType) for c in ("step", "pos")]
    return T.StructType([
        T.StructField("session_id", like.schema["session_id"].dataType), T.StructField("kind", T.StringType()), T.StructField("seq", T.LongType()),
        T.StructField("token", T.StringType()), *held, T.StructField("raw_value", T.StringType()),
    ])


def registrations(tokenised: DataFrame) -> DataFrame:
    """Tokens with their raw value; a token of an empty field has none, but its number is taken."""
    return tokenised.select("session_id", "kind", "seq", "token", "step", "pos", F.nullif(F.col("value"), F.lit("")).alias("raw_value"))


def tokens(elements: DataFrame, known: DataFrame | None) -> DataFrame:
    """Elements that have a ``kind`` with their ``token``: numbered per session and kind by (step, page_id, pos), nulls
    first, after those that are ``known`` from earlier batches."""
    keyed = elements.where(F.col("kind").isNotNull()).withColumns({
        "_s": F.struct("session_id"), "_new": F.lit(True), "_one": F.lit(1).cast("long"),
    })
    rows = keyed
    if known is not None:
        taken = known.groupBy("session_id", "kind").agg(F.max("seq").alias("_one")).withColumns({"_s": F.struct("session_id"), "_new": F.lit(False)})
        rows = keyed.unionByName(taken, allowMissingColumns=True)
    at = F.coalesce(F.floor(F.col("step") / V.STEP_BUCKET), F.lit(_FIRST + 1))
    bucket = F.when(F.col("_new"), at).otherwise(F.lit(_FIRST))
    numbered = running_total(rows, ["_s", "kind"], bucket, ["_new", "step", "page_id", "pos"], F.col("_one"), "seq")
    token = F.concat(F.lit("["), "kind", F.lit("_"), F.col("seq").cast("string"), F.lit("]"))
    return numbered.where("_new").drop("_s", "_new", "_one").withColumn("token", token)

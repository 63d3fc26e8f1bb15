"""Keyed state of streaming jobs: a session's vault and its plan cursor.

State lives in Spark's own state store (RocksDB, checkpointed with the stream), so a
restarted query or a repeated micro-batch goes on from what was committed. A key's rows of
one micro-batch are put in order by one task; ``maxFilesPerTrigger`` of the source bounds
them. What outlives a batch is a count per kind, the vault's entries and one plan a session.
Whole steps (``jobs.step_sink``) keep their vault in tables (``vaults``) and need no such task.

Rows are numbered in the order in which they arrive: micro-batch by micro-batch, and inside
one by the order columns (nulls first). Nothing is dropped for being late: no watermark is
involved, a late row simply comes next. A null session is a session like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspark import fixed
from veilspark.session import ship_package

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FORGET_AFTER_MS = 24 * 3600 * 1000
"""Time without calls, as they arrive, after which the state of a session is removed."""


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    ship_package(spark)


def _ordered(rows: Iterator[Row], order: Sequence[str]) -> list[Row]:
    return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in order))


def _nullable(df: DataFrame, columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in columns])


# ---------------------------------------------------------------------------
class _Vault(StatefulProcessor):
    """Vault entries of one (session, kind): number -> value; a reset clears them and starts a new epoch."""

    def __init__(self, columns: Sequence[str], order: Sequence[str]):
        self.columns, self.order = list(columns), list(order)
        self.out = Row(*columns, "epoch", "seq", "held_value")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "epoch bigint, seq bigint")
        self.entries = handle.getMapState("entries", "seq bigint", "raw_value string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        epoch, seq = self.at.get() if self.at.exists() else (0, 0)
        for row in _ordered(rows, self.order):
            number, value = None, None
            if row["is_reset"]:
                epoch, seq = epoch + 1, 0
                self.entries.clear()
            elif row["asked"] is not None:
                number = row["asked"]
                value = self.entries.getValue((number,))[0] if self.entries.containsKey((number,)) else None
            else:
                seq += 1
                number, value = seq, row["raw_value"]
                self.entries.updateValue((seq,), (value,))
            yield self.out(*[row[c] for c in self.columns], epoch, number, value)
        self.at.update((epoch, seq))

    def close(self) -> None:
        pass


def vault_stream(records: DataFrame, order: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Tokens of a stream of sensitive values, requests for them, and resets.

    ``records``: session_id, kind, raw_value, is_reset, asked and the order columns. A row with ``asked`` wants the
    value that the kind's token of that number has now; one with ``is_reset`` clears its session; any other registers
    its value. Adds epoch (resets so far), seq, token and held_value (what the token stands for, null if unknown or a
    reset). A session's kinds are keyed apart, so that a busy session is spread over them; a reset goes to each of
    ``kinds`` and comes out once, with the null kind's.
    """
    _ready(records.sparkSession)
    reset = F.coalesce("is_reset", F.lit(False))
    every = F.array(*[F.lit(k) for k in kinds], F.lit(None).cast("string"))
    lanes = records.withColumn("is_reset", reset).withColumn(
        "lane", F.explode(F.when(F.col("is_reset"), every).otherwise(F.array("kind")))
    )
    columns = lanes.columns
    schema = _nullable(lanes, columns).add("epoch", T.LongType()).add("seq", T.LongType()).add("held_value", T.StringType())
    numbered = lanes.groupBy("session_id", "lane").transformWithState(_Vault(columns, order), schema, "Append", "None")
    token = F.concat(F.lit("["), "kind", F.lit("_"), F.col("seq").cast("string"), F.lit("]"))
    return numbered.where(~F.col("is_reset") | F.col("lane").isNull()).withColumn("token", token).drop("lane")


def current_vault(rows: DataFrame) -> DataFrame:
    """Registered rows of the latest epoch of each session, from what the stream has written."""
    latest = rows.groupBy("session_id").agg(F.max("epoch").alias("_latest"))
    held = rows.where(~F.col("is_reset") & F.col("asked").isNull())
    return held.join(latest, held["session_id"].eqNullSafe(latest["session_id"]) & (F.col("epoch") == F.col("_latest")), "left_semi")


# ---------------------------------------------------------------------------
_TEXTS = ("action", "selector", "value", "reasoning")
_ACTION = T.StructType([*[T.StructField(c, T.StringType()) for c in _TEXTS], T.StructField("confidence", T.DoubleType())])


class _Cursor(StatefulProcessor):
    """One session's plan, the place in it and when it was last asked."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], idle_us: int, forget_ms: int):
        self.columns, self.order, self.idle_us, self.forget_ms = list(columns), list(order), idle_us, forget_ms
        self.out = Row(*columns, "run", "fresh", *_ACTION.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getListState("plan", _ACTION)
        self.at = handle.getValueState("at", "run bigint, place int, last_us bigint, timer bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        run, place, last, timer = self.at.get() if self.at.exists() else (0, None, None, None)
        plan = [tuple(a) for a in self.plan.get()] if place is not None else []
        changed = False
        for row in _ordered(rows, self.order):
            now, arrived = row["at_us"], row["arrived_ms"]
            idle = last is not None and now is not None and now - last > self.idle_us
            fresh = place is None or row["step"] == 0 or idle
            if fresh:
                run += 1
            again = not fresh and place >= len(plan) and row["has_empty"] and (row["step"] or 0) > 0
            if fresh or again:  # plan anew from what the page shows now
                plan, place, changed = [tuple(a[c] for c in _ACTION.names) for a in row["plan"]], 0, True
            last = now if last is None else last if now is None else max(last, now)
            if place < len(plan):
                answer, place = plan[place], place + 1
            else:
                answer = ("finish", "", None, fixed.PLAN_TEXT["idle"], fixed.PLAN_CONFIDENCE["idle"])
            yield self.out(*[row[c] for c in self.columns], run, fresh, *answer)
        if changed and plan:
            self.plan.put(plan)
        elif changed:
            self.plan.clear()  # a list state holds no empty list
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = arrived + self.forget_ms
        self.handle.registerTimer(timer)
        self.at.update((run, place, last, timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.plan.clear()
        self.at.clear()
        return iter([])

    def close(self) -> None:
        pass


def cursor_stream(calls: DataFrame, ts: str, order: Sequence[str], idle_seconds: int = fixed.SESSION_IDLE_SECONDS,
                  forget_ms: int = FORGET_AFTER_MS) -> DataFrame:
    """Answers a stream of planner calls.

    ``calls``: session_id, step, has_empty, plan (what the page of the call asks for: array of action, selector, value,
    reasoning, confidence), the time and the order columns. A session without a plan, at step 0, or silent for more
    than ``idle_seconds`` by its calls' own times takes the plan of its call; a finished plan is made anew while fields
    are empty; else the answer is "finish". Adds run, fresh and the answer's columns. An event-time timer, on the time
    of arrival, removes sessions that have been silent for ``forget_ms``.
    """
    _ready(calls.sparkSession)
    nothing = F.array().cast(calls.schema["plan"].dataType)
    arriving = calls.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 second")
    ready = arriving.withColumns({
        "at_us": F.unix_micros(F.col(ts)), "has_empty": F.coalesce("has_empty", F.lit(False)),
        "plan": F.coalesce("plan", nothing), "arrived_ms": F.unix_millis("arrived"),
    })
    columns = [c for c in calls.columns if c not in ("plan", "has_empty")]
    schema = _nullable(calls, columns).add("run", T.LongType()).add("fresh", T.BooleanType())
    for field in _ACTION.fields:
        schema = schema.add(field)
    cursor = _Cursor(columns, order, idle_seconds * 1_000_000, forget_ms)
    return ready.groupBy("session_id").transformWithState(cursor, schema, "Append", "EventTime")


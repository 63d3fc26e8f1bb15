"""Session jobs: idle gaps, step budget, restarts, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import geometry as G
from veilspark.operators.ranking import running_total

TIMINGS = ("capture_ms", "dom_ms", "perception_ms", "redaction_ms", "network_ms", "exec_ms")


def activity_slots(events: DataFrame, key: str, ts: str, gap_seconds: int = fixed.SESSION_IDLE_SECONDS) -> DataFrame:
    """Events of a key by slots of half a gap: first, last and number.

    A slot never contains an idle period, so it lies in one session; slots of
    several batches add up, in any order.
    """
    t = F.unix_micros(F.col(ts))
    return events.groupBy(key, F.floor(t / (gap_seconds * 500_000)).alias("slot")).agg(
        F.min(t).alias("first_us"), F.max(t).alias("last_us"), F.count("*").alias("n")
    )


def sessions_of_slots(slots: DataFrame, key: str, gap_seconds: int = fixed.SESSION_IDLE_SECONDS) -> DataFrame:
    """Sessions out of activity slots, which may have several rows each."""
    whole = slots.groupBy(key, "slot").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n")
    )
    order = Window.partitionBy(key).orderBy("slot")
    fresh = F.coalesce(F.col("first_us") - F.lag("last_us").over(order) > gap_seconds * 1_000_000, F.lit(True))
    numbered = whole.withColumn("_new", fresh.cast("int")).withColumn("session_no", F.sum("_new").over(order))
    return numbered.groupBy(key, "session_no").agg(
        F.timestamp_micros(F.min("first_us")).alias("session_start"),
        F.timestamp_micros(F.max("last_us")).alias("session_end"),
        F.sum("n").alias("events"),
    )


def idle_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int = fixed.SESSION_IDLE_SECONDS) -> DataFrame:
    """Sessions split where a key was idle for more than ``gap_seconds``.

    Events are first reduced to slots; the reduction is a partial aggregate, so a
    hot key shrinks to one row per slot before anything is ordered.
    """
    return sessions_of_slots(activity_slots(events, key, ts, gap_seconds), key, gap_seconds)


def total_ms(digits: int = 1) -> Column:
    """Sum of the stage timings, a missing last stage counted as zero."""
    parts = [F.coalesce(c, F.lit(0.0)) if c == "exec_ms" else F.col(c) for c in TIMINGS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return G.round_half_up(total, digits)


def end_reasons(steps: DataFrame, session: str, order: list[str], is_finish: Column, is_fatal: Column, budget: int = fixed.STEP_BUDGET) -> DataFrame:
    """Steps used and why a session ended, looking at its first ``budget`` steps.

    The row-number limit is applied before the shuffle as well as after it, so
    a long session sends at most ``budget`` rows per task.
    """
    first = steps.withColumns({"_finish": is_finish, "_fatal": is_fatal}).select(session, *order, "_finish", "_fatal")
    rn = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    used = first.withColumn("_rn", rn).filter(F.col("_rn") <= budget)
    stop = F.when(F.col("_finish") | F.col("_fatal"), F.struct("_rn", F.col("_fatal").alias("fatal")))
    return (
        used.groupBy(session)
        .agg(F.min(stop).alias("_stop"), F.max("_rn").alias("_seen"))
        .select(
            session,
            F.coalesce("_stop._rn", "_seen").alias("steps"),
            F.when(F.col("_stop.fatal"), "fatal")
            .when(F.col("_stop").isNotNull(), "finish")
            .when(F.col("_seen") >= budget, "exhausted")
            .otherwise("stopped")
            .alias("reason"),
        )
    )


def newest(steps: DataFrame, session: str, order: list[str], limit: int = fixed.INSPECTOR_ROWS) -> DataFrame:
    """The newest ``limit`` steps of each session, with ``rank`` from 1.

    The limit on the row number runs in each task before the shuffle and once more after it, so a session sends at most
    ``limit`` rows per task, however many it has. Steps without a time come last.
    """
    rank = F.row_number().over(Window.partitionBy(session).orderBy(*[F.desc(c) for c in order]))
    return steps.withColumn("rank", rank).filter(F.col("rank") <= limit)


def restart_runs(steps: DataFrame, session: str, ts: str, tie: str, step: str) -> DataFrame:
    """Run number of each row: step 0 starts a new run of its session."""
    slot = F.floor(F.unix_micros(F.col(ts)) / 600_000_000)  # ten minutes
    return running_total(
        steps, [session], slot, [ts, tie], F.when(F.col(step) == 0, 1).otherwise(0), "run"
    )


def telemetry_by_session(steps: DataFrame, session: str, ts: str, tie: str) -> DataFrame:
    """Mean and worst total, slow steps, and the latest step per session."""
    t = steps.withColumn("total_ms", total_ms())
    return t.groupBy(session).agg(
        F.count("*").alias("steps"),
        F.avg("total_ms").alias("mean_ms"),
        F.max("total_ms").alias("worst_ms"),
        F.count_if(F.col("total_ms") > fixed.SLOW_STEP_MS).alias("slow_steps"),
        F.max_by("step", F.struct(ts, tie)).alias("latest_step"),
        F.max_by("total_ms", F.struct(ts, tie)).alias("latest_ms"),
    )

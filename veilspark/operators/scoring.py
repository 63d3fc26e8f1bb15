"""The five scores and their weighted total, over tables of any number of pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import geometry as G
from veilspark.operators import boxes as B
from veilspark.operators import matching as M
from veilspark.session import grows


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row aggregates as one row."""
    return left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k").drop("_k")


def class_match_counts(truth: DataFrame, faces: DataFrame, found: DataFrame, page: Sequence[str]) -> DataFrame:
    """tp, fp, fn of detections against sensitive selectors and faces, one row.

    ``truth`` (page, selector), ``faces`` (page, face_id, face_box), ``found``
    (page, pos, selector, box).  A detection meets the truth by selector, else by
    the face it overlaps best; two detections may meet one truth, and a truth is
    missed once.
    """
    def face_key(c: str) -> Column:
        return F.concat(F.lit("face["), F.col(c).cast("string"), F.lit("]"))

    keys = truth.select(*page, "selector").distinct()
    named = keys.filter(F.coalesce("selector", F.lit("")) != "").withColumn("_gt", F.lit(True))
    best = M.best_overlap(found, "pos", "box", faces, "face_id", "face_box", page)
    hit = F.when(F.col("_gt"), F.col("selector")).when(F.col("best_iou") >= fixed.FACE_IOU, face_key("best_id"))
    hits = grows(best).join(named, [*page, "selector"], "left").select(*page, hit.alias("key"))
    wanted = keys.select(*page, F.col("selector").alias("key")).unionByName(
        faces.select(*page, face_key("face_id").alias("key"))
    )
    # reported keys are counted per key first, then met with the truth
    per_key = hits.groupBy(*page, "key").agg(F.count("*").alias("n"))
    met = grows(wanted.distinct()).join(per_key.filter(F.col("key").isNotNull()), [*page, "key"], "left")
    totals = per_key.agg(
        F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("fp"),
    )
    return side_by_side(totals, met.agg(F.count_if(F.col("n").isNull()).alias("fn"))).select("tp", "fp", "fn")


def region_quality(truth: DataFrame, applied: DataFrame, page: Sequence[str]) -> DataFrame:
    """Best IoU and capped coverage of each true region by the applied boxes.

    ``truth`` (page, gt_pos, gt_box), ``applied`` (page, pos, box).  Coverage adds
    the overlaps of all applied boxes before it is capped.
    """
    best = M.best_overlap(truth, "gt_pos", "gt_box", applied, "pos", "box", page)
    share = F.col("overlap") / F.greatest(F.lit(1e-9), G.area(F.col("gt_box")))
    return best.withColumn("coverage", F.least(F.lit(1.0), share))


def redaction_summary(
    truth: DataFrame, applied: DataFrame, gates: DataFrame, page: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Mean IoU, coverage, over-masking, penalty, gate and score, one row, or one per value of ``by`` (columns of
    ``truth`` that a page has one value of).

    ``gates`` (page, ok): one closed gate, or one of unknown state, sets the score to zero.
    """
    of_page = truth.select(*page, *by).distinct()
    truth = truth.drop(*by)

    def grouped(rows: DataFrame):
        return grows(rows).join(of_page, list(page)).groupBy(*by) if by else rows.groupBy()

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, list(by)) if by else side_by_side(left, right)

    quality = grouped(region_quality(truth, applied, page)).agg(
        F.avg("best_iou").alias("mean_iou"), F.avg("coverage").alias("mean_coverage")
    )
    ub = B.union_per(applied.select(*page, "box"), *page)
    ug = B.union_per(truth.select(*page, F.col("gt_box").alias("box")), *page).withColumnRenamed("box", "gt_box")
    a, g = F.col("box"), F.col("gt_box")
    over = grouped(grows(ub).join(ug, list(page))).agg(
        (
            F.sum(F.greatest(F.lit(0.0), G.area(a) - G.overlap_area(a, g))) / F.greatest(F.lit(1e-9), F.sum(G.area(a)))
        ).alias("overmask")
    )
    gate = grouped(gates).agg(F.coalesce(F.bool_and(F.coalesce("ok", F.lit(False))), F.lit(True)).alias("gates_ok"))
    one = beside(beside(quality, over), gate)
    raw = 100 * (0.45 * F.col("mean_iou") + 0.55 * F.col("mean_coverage")) * (1 - F.col("penalty"))
    return (
        one.withColumn("penalty", G.clamp((F.col("overmask") - 0.10) / 0.40, 0.0, 0.5))
        .withColumn("ungated", raw)
        .withColumn("score", F.when(F.col("gates_ok"), raw).otherwise(0.0))
    )


def speed_scores(steps: DataFrame, heap_mb: Column, perception: Column, redaction: Column, server: Column) -> DataFrame:
    """Resource and latency scores from per-step figures, one row."""
    mean = steps.groupBy().agg(
        F.avg(heap_mb).alias("heap"),
        F.avg(perception).alias("perception"),
        F.avg(redaction).alias("redaction"),
        F.avg(server).alias("server"),
    )
    memory = G.linear_score(F.col("heap"), *fixed.HEAP_BAND_MB)
    quick = G.linear_score(F.col("perception"), *fixed.PERCEPTION_BAND_MS)
    cycle = F.col("perception") + F.col("redaction") + F.col("server")
    return mean.select(
        "heap",
        "perception",
        cycle.alias("cycle_ms"),
        (100 * (0.5 * memory + 0.5 * quick)).alias("resource"),
        (100 * G.linear_score(cycle, *fixed.CYCLE_BAND_MS)).alias("latency"),
    )


def metric_rows(figures: DataFrame, **metrics: Column) -> DataFrame:
    """(metric, score) rows out of the one row of ``figures``."""
    rows = [F.struct(F.lit(name).alias("metric"), score.cast("double").alias("score")) for name, score in metrics.items()]
    return figures.select(F.inline(F.array(*rows)))


def composite(*scores: DataFrame) -> DataFrame:
    """Metric rows and their weighted total, out of frames of (metric, score)."""
    weight = F.lit(None)
    for name, share in fixed.METRIC_WEIGHTS.items():
        weight = F.when(F.col("metric") == name, F.lit(share)).otherwise(weight)
    rows = reduce(DataFrame.unionByName, scores).withColumn("w", F.col("score") * weight)
    total = rows.rollup("metric").agg(F.sum("score").alias("score"), F.sum("w").alias("w"))
    return total.select(
        F.coalesce("metric", F.lit("composite")).alias("metric"),
        F.when(F.col("metric").isNull(), F.col("w")).otherwise(F.col("score")).alias("score"),
    )

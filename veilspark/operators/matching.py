"""Set matches and box matches between expected and reported rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import geometry as G
from veilspark.session import grows

GRID_PX = 256


def set_match(expected: DataFrame, reported: DataFrame, page: Sequence[str], key: str) -> DataFrame:
    """Full outer match of distinct keys: one row per key with both flags."""
    e = expected.select(*page, key).distinct().withColumn("expected", F.lit(True))
    r = reported.select(*page, key).distinct().withColumn("reported", F.lit(True))
    return grows(e).join(r, [*page, key], "full_outer").na.fill(False, ["expected", "reported"])


def match_counts(flags: DataFrame, *page: str) -> DataFrame:
    """tp, fp, fn per page, and a total row (NULL page) from the small per-page table."""
    e, r = F.col("expected"), F.col("reported")
    per_page = flags.groupBy(*page).agg(
        F.count_if(e & r).alias("tp"), F.count_if(r & ~e).alias("fp"), F.count_if(e & ~r).alias("fn")
    )
    return per_page.rollup(*page).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def with_scores(counts: DataFrame) -> DataFrame:
    one = F.lit(1)
    p = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))
    return (
        counts.withColumn("precision", p)
        .withColumn("recall", r)
        .withColumn(
            "f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall"))
        )
    )


def _cell(v: Column) -> Column:
    return F.floor(v / GRID_PX)


def _gridded(boxes: DataFrame, box: str) -> DataFrame:
    b = F.col(box)
    last_x, last_y = _cell(F.greatest(b["x"], G.right(b) - 1e-9)), _cell(F.greatest(b["y"], G.bottom(b) - 1e-9))
    xs, ys = F.sequence(_cell(b["x"]), last_x), F.sequence(_cell(b["y"]), last_y)
    return boxes.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def overlapping(left: DataFrame, left_box: str, right: DataFrame, right_box: str, page: Sequence[str]) -> DataFrame:
    """Pairs of boxes of one page that overlap, each pair once.

    Both sides are cut by a pixel grid, so only boxes near each other meet; a
    pair counts in the one cell that holds the corner of its intersection.
    """
    a, b = F.col(left_box), F.col(right_box)
    pairs = grows(_gridded(left, left_box)).join(_gridded(right, right_box), [*page, "_cx", "_cy"])
    corner = (F.col("_cx") == _cell(F.greatest(a["x"], b["x"]))) & (F.col("_cy") == _cell(F.greatest(a["y"], b["y"])))
    return pairs.filter(corner & (G.overlap_area(a, b) > 0)).drop("_cx", "_cy")


def best_overlap(
    left: DataFrame, left_id: str, left_box: str, right: DataFrame, right_id: str, right_box: str, page: Sequence[str]
) -> DataFrame:
    """Per left box: best IoU (0 without overlap), its partner, and the summed overlap area."""
    pairs = overlapping(
        left.select(*page, left_id, left_box), left_box, right.select(*page, right_id, right_box), right_box, page
    )
    a, b = F.col(left_box), F.col(right_box)
    best = pairs.groupBy(*page, left_id).agg(
        F.max(F.struct(G.iou(a, b).alias("iou"), F.col(right_id).alias("id"))).alias("_b"),
        F.sum(G.overlap_area(a, b)).alias("overlap"),
    )
    return grows(left).join(best, [*page, left_id], "left").select(
        *left.columns,
        F.coalesce("_b.iou", F.lit(0.0)).alias("best_iou"),
        F.col("_b.id").alias("best_id"),
        F.coalesce("overlap", F.lit(0.0)).alias("overlap"),
    )

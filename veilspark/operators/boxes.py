"""Order-dependent box jobs per page or image, and coordinate fusion.

One group is one screenshot, the natural unit of these folds; within it they look
boxes up in a grid (``functions.boxlists``), so a page may have very many.  Lists
are exploded in the outer form, because the inner form makes the optimizer
repeat the list expression in a size filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import boxlists as L
from veilspark.functions import geometry as G
from veilspark.session import grows, ship_package

ITEM = f"struct<pos:bigint,box:{G.BOX},confidence:double,pii_type:string,mode:string>"


def _items(where: Column | None = None) -> Column:
    item = F.struct(
        F.col("pos").cast("long").alias("pos"), F.col("box"), F.col("confidence"), F.col("pii_type"), F.col("mode")
    ).cast(ITEM)
    return F.array_sort(F.collect_list(item if where is None else F.when(where, item)))


def deduped(boxes: DataFrame, *keys: str, threshold: float = fixed.DEDUPE_IOU) -> DataFrame:
    ship_package(boxes.sparkSession)
    kept = boxes.groupBy(*keys).agg(_items().alias("_i")).withColumn("_k", L.kept_at(F.col("_i.box"), threshold))
    rows = kept.select(*keys, "_i", F.explode_outer("_k").alias("_n")).filter(F.col("_n").isNotNull())
    return rows.select(*keys, F.element_at("_i", F.col("_n")).alias("_x")).select(*keys, "_x.*")


def merged(
    boxes: DataFrame, *keys: str, min_iou: float = fixed.MERGE_IOU, min_containment: float = fixed.MERGE_CONTAINMENT
) -> DataFrame:
    """Groups of overlapping boxes as one union box with the metadata of the most
    confident member (the first on ties)."""
    big_enough = (F.col("box.width") >= 1) & (F.col("box.height") >= 1)
    ship_package(boxes.sparkSession)
    groups = (
        boxes.groupBy(*keys)
        .agg(_items(big_enough).alias("_i"))
        .withColumn("_m", L.groups_at(F.col("_i.box"), min_iou, min_containment))
        .select(*keys, "_i", F.posexplode_outer("_m").alias("grp", "_m"))
        .filter(F.col("_m").isNotNull())
        .select(*keys, "grp", F.transform("_m", lambda n: F.element_at("_i", n)).alias("_g"))
    )
    union = F.aggregate(
        F.slice("_g", F.lit(2), F.size("_g")), F.element_at("_g", 1)["box"], lambda acc, d: G.union_box(acc, d["box"])
    )
    best = F.aggregate(
        F.slice("_g", F.lit(2), F.size("_g")),
        F.element_at("_g", 1),
        lambda acc, d: F.when(F.coalesce(d["confidence"], F.lit(0.0)) > F.coalesce(acc["confidence"], F.lit(0.0)), d)
        .otherwise(acc),
    )
    return groups.select(*keys, "grp", union.alias("box"), best.alias("_best"), F.size("_g").alias("members")).select(
        *keys, "grp", "box", "members", "_best.confidence", "_best.pii_type", "_best.mode"
    )


def unions(boxes: DataFrame, *keys: str, threshold: float = fixed.UNION_IOU) -> DataFrame:
    ship_package(boxes.sparkSession)
    packed = boxes.groupBy(*keys).agg(_items().alias("_i")).withColumn("_u", L.grown_boxes(F.col("_i.box"), threshold))
    rows = packed.select(*keys, F.posexplode_outer("_u").alias("ord", "box"))
    return rows.filter(F.col("box").isNotNull())


def fused(detections: DataFrame, frames: DataFrame, *keys: str) -> DataFrame:
    """CSS pixels to capture pixels; ``frames`` has the viewport and image sizes."""
    sx = F.col("image_width") / F.greatest(F.lit(1.0), F.col("viewport_width"))
    sy = F.col("image_height") / F.greatest(F.lit(1.0), F.col("viewport_height"))
    return grows(detections).join(frames, list(keys)).withColumn("box", G.scale_box(F.col("box"), sx, sy))


def redaction_boxes(groups: DataFrame, width, height, pad: float = fixed.REDACTION_PAD) -> DataFrame:
    """Padded, clamped integer boxes with the pixelation block of blurred ones."""
    b = F.col("box")
    side = F.least(b["width"], b["height"])
    block = F.when(
        F.coalesce("mode", F.lit(fixed.DEFAULT_MODE)) != "blackout", F.greatest(F.lit(6.0), G.round_half_up(side / 6))
    ).cast("int")
    return (
        groups.withColumn("box", G.round_box(G.expand_box(b, pad, width, height)))
        .filter((F.col("box.width") >= 1) & (F.col("box.height") >= 1))
        .withColumn("block", block)
    )


def union_per(boxes: DataFrame, *keys: Sequence[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(G.union_box_agg(F.col("box")).alias("box"))

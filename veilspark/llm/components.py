"""Connected components of a large edge table by alternating large and small stars.

Each round is a few grouped minima and joins; no node's neighbours are ever
gathered in one place. The table between rounds is written to the shared folder,
and the driver only sees its row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.session import materialise


def _least(pairs: DataFrame) -> DataFrame:
    """u, low: the smallest of a node and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = _least(edges)  # every edge points from the larger node to a smaller one
    kept = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return kept.union(low.withColumnRenamed("low", "v"))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root for every node of ``edges`` (u, v) but the roots, each of which is its component's least node."""
    now = materialise(
        _clean(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "components"
    )
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.withColumnRenamed("v", "root")
        before = state
        now = materialise(_clean(_small_star(_clean(_large_star(now)))), "components")

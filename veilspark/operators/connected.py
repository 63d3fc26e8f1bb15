"""Connected components of a large edge table by alternating large and small stars.

Each round is a few grouped minima and joins; no node's neighbours are ever gathered in one
place. The table between rounds is written to the shared folder, and the driver only sees
its row count and a checksum. Nodes are of any ordered type without nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.session import materialise


def _lowest(pairs: DataFrame) -> DataFrame:
    """node, low: the least of a node and its neighbours."""
    return pairs.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("low"))


def _round(down: DataFrame) -> DataFrame:
    """``down`` (node > other): neighbours above a node, then those below it, move to its least neighbour."""
    both = down.unionByName(down.select(F.col("other").alias("node"), F.col("node").alias("other")))
    above = both.join(_lowest(both), "node").where("other > node").select(F.col("other").alias("node"), F.col("low").alias("other"))
    above = above.where("node <> other").distinct()
    low = _lowest(above)
    moved = above.join(low, "node").select(F.col("other").alias("node"), F.col("low").alias("other"))
    return moved.unionByName(low.withColumnRenamed("low", "other")).where("node <> other").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """node, root for each node of ``edges`` (a, b) that is not itself the least of its component."""
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct()
    now, before = materialise(start, "connected"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.withColumnRenamed("other", "root")
        now, before = materialise(_round(now), "connected"), state

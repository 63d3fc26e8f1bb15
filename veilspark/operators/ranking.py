"""Numbering and running totals that stay spread when one key is hot.

A plain window keeps all rows of a key in one task.  Here the order column is
cut into coarse buckets: rows are numbered inside (key, bucket), the bucket
totals - a small pre-aggregated table - give each bucket its start, and both
parts are added.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.session import grows


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    amount: Column,
    output: str,
) -> DataFrame:
    """Inclusive running sum of ``amount`` per key in ``order``.

    ``bucket`` must be a non-decreasing function of ``order`` within a key.
    """
    slim = df.withColumn("_bucket", bucket).withColumn("_amount", amount.cast("long"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slim.groupBy(*keys, "_bucket")
        .agg(F.sum("_amount").alias("_total"))
        .withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        grows(slim.withColumn("_inside", F.sum("_amount").over(inside)))
        .join(starts, [*keys, "_bucket"])
        .withColumn(output, F.col("_start") + F.col("_inside"))
        .drop("_bucket", "_amount", "_start", "_inside")
    )


def numbered(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], output: str = "seq"
) -> DataFrame:
    """1-based position of each row within its key."""
    return running_total(df, keys, bucket, order, F.lit(1), output)


def exact_rank_value(
    df: DataFrame, keys: Sequence[str], value: str, index: Column, output: str, width: float = 1.0
) -> DataFrame:
    """Value at a 0-based ``index`` (an expression over the row count ``n``) of
    the ascending order, per key.

    Equal values are counted first, so a hot value is one row.  A histogram of
    equal-width buckets finds the bucket that holds the rank; only that bucket
    is ordered.
    """
    counts = (
        df.groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_b", F.floor(F.col("_v") / width))
    )
    per_key = Window.partitionBy(*keys)
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    target = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("n", F.sum("_bc").over(per_key))
        .withColumn("_end", F.sum("_bc").over(upto))
        .withColumn("_i", F.greatest(index, F.lit(0)))
        .filter((F.col("_i") < F.col("_end")) & (F.col("_i") >= F.col("_end") - F.col("_bc")))
        .select(*keys, "_b", "n", "_i", (F.col("_end") - F.col("_bc")).alias("_base"))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(target, [*keys, "_b"])
        .withColumn("_pos", F.col("_base") + F.sum("_c").over(inside))
        .filter((F.col("_i") < F.col("_pos")) & (F.col("_i") >= F.col("_pos") - F.col("_c")))
        .select(*keys, "n", F.col("_v").alias(output))
    )

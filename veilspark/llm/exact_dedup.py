"""Exact deduplication of a new batch against an immutable snapshot.

A snapshot is a table of text digests in hash buckets, with one static binary
fuse filter per bucket. The digests of a batch are first grouped among
themselves, then screened by the filters; only positives meet the exact bucket,
where digest, length and finally the bytes of both texts are compared. Text
moves once, for the byte check; everything else works on digests.

Results for odd input: a null text counts as empty; empty texts are equal to
each other; rows that repeat an id with the same text are counted one by one
and share their verdict; a null id never stays while its group has another id;
a very long text is hashed where it is and moves only if it may have a copy on the
other side; an empty table gives no rows; other columns of the input are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import fuse
from veilspark.llm.common import buckets_for, sha256_hex, text_or_empty
from veilspark.session import materialise, ship_package

PER_BUCKET = 200_000
"""Digests per bucket: a filter of about 230 kB, and what one task holds of a snapshot."""

_KEY = ["bucket", "sha", "n_bytes"]


@dataclass(frozen=True)
class Snapshot:
    """``groups``: bucket, sha, n_bytes, keep_id, size. ``filters``: one row per bucket."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def digests(docs: DataFrame, in_snapshot: Column, id_col: str, text_col: str) -> DataFrame:
    """id, sha (hex SHA-256 of the text), n_bytes, old (the row belongs to the snapshot)."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"), sha256_hex(text).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.coalesce(in_snapshot, F.lit(False)).alias("old"),
    )


def groups(rows: DataFrame, buckets: int) -> DataFrame:
    """Equal digests of one set of rows: the largest id and the number of rows."""
    return (
        rows.groupBy("sha", "n_bytes")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
        .withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(buckets)).cast("int"))
    )


def _keys(sha: pd.Series) -> np.ndarray:
    return np.array([int(s[:16], 16) for s in sha], dtype=np.uint64)


def _filter_of(part: pd.DataFrame) -> pd.DataFrame:
    f = fuse.build(_keys(part["sha"]))
    return pd.DataFrame(
        {"bucket": [part["bucket"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "starts": [f.starts],
         "prints": [f.prints.tobytes()]}
    )


def snapshot(rows: DataFrame, buckets: int) -> Snapshot:
    """Freeze the digests ``rows`` (id, sha, n_bytes): exact buckets, and a filter for each."""
    spark = rows.sparkSession
    ship_package(spark)
    exact = materialise(groups(rows, buckets).repartition(F.col("bucket")), "dedup-buckets")
    filters = exact.select("bucket", "sha").groupBy("bucket").applyInPandas(
        _filter_of, "bucket int, seed int, segment int, starts long, prints binary"
    )
    return Snapshot(exact, materialise(filters, "dedup-filters"), buckets)


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if batch.empty or filters.empty:
        return batch.assign(maybe=False)
    row = filters.iloc[0]
    f = fuse.Fuse(int(row.seed), int(row.segment), int(row.starts), np.frombuffer(row.prints, np.uint8))
    return batch.assign(maybe=f.contains(_keys(batch["sha"])))


def screened(batch: DataFrame, snap: Snapshot) -> DataFrame:
    """The batch's groups with ``maybe``: false only for digests that the snapshot lacks."""
    return (
        batch.groupBy("bucket").cogroup(snap.filters.groupBy("bucket"))
        .applyInPandas(_screen, "sha string, n_bytes long, keep_id long, size long, bucket int, maybe boolean")
    )


def byte_checked(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of ``pairs`` (_KEY, keep_id, old_id), those whose two texts have equal bytes.

    An id may repeat with other texts of this length, so a pair needs one text that both of its ids have. A group
    whose ids are all null finds its texts by their digest.
    """
    ends = pairs.select(*_KEY, F.posexplode(F.array("keep_id", "old_id")).alias("end", "id"))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    nameless = texts.where("id IS NULL").withColumn("sha", sha256_hex(F.col("text")))
    named = texts.join(ends, "id").where(F.octet_length("text") == F.col("n_bytes")).select(*_KEY, "text", "end")
    same = (
        named.unionByName(nameless.drop("id").join(ends.where("id IS NULL"), "sha").select(*_KEY, "text", "end"))
        .groupBy(*_KEY, "text").agg(F.min("end").alias("low"), F.max("end").alias("high"))
        .where(F.col("low") < F.col("high")).select(*_KEY).distinct()
    )
    return pairs.join(same, _KEY)


def dedup(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text",
          per_bucket: int = PER_BUCKET) -> DataFrame:
    """Equal texts of a snapshot (rows where ``in_snapshot``) and a batch (the others).

    One row per input row: id, keep_id, group_size, kept, text_sha256, side.
    """
    rows = materialise(digests(docs, in_snapshot, id_col, text_col), "dedup-digests")
    buckets = buckets_for(rows.count(), per_bucket)
    snap = snapshot(rows.where("old"), buckets)
    new = materialise(screened(groups(rows.where(~F.col("old")), buckets), snap), "dedup-batch")
    positives = new.where("maybe").join(
        snap.groups.select(*_KEY, F.col("keep_id").alias("old_id"), F.col("size").alias("old_size")), _KEY
    )
    both = materialise(
        byte_checked(positives, docs, id_col, text_col).select(
            "sha", "n_bytes", F.greatest("keep_id", "old_id").alias("all_keep"),
            (F.col("size") + F.col("old_size")).alias("all_size"),
        ),
        "dedup-positives",
    )
    sides = snap.groups.select("sha", "n_bytes", "keep_id", "size", F.lit(True).alias("old")).unionByName(
        new.select("sha", "n_bytes", "keep_id", "size", F.lit(False).alias("old"))
    )
    final = sides.join(both, ["sha", "n_bytes"], "left").select(
        "sha", "n_bytes", "old", F.coalesce("all_keep", "keep_id").alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
    )
    return rows.join(final, ["sha", "n_bytes", "old"]).select(
        F.col("id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"), F.when(F.col("old"), "snapshot").otherwise("batch").alias("side"),
    )


def by_half(id_col: str) -> Column:
    """The split that the query uses: an id's CRC decides whether it is in the snapshot or in the batch."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0

"""SimHash near-duplicates by covering locality-sensitive hashing.

1. A document's fingerprint has a bit set where over half of its shingles' hashes
   have it; equal fingerprints are one class, and only classes are compared.
2. Bit i of a fingerprint gets a non-zero vector m(i) of ``radius + 1`` bits, and
   every non-zero vector v a mask of the bits with <m(i), v> = 1. Up to ``radius``
   differing bits span at most ``radius`` dimensions, so some v is orthogonal to all
   of them: its mask skips every differing bit. Each pair within the radius therefore
   agrees under at least one mask, whatever the data. The vectors are dealt evenly, so
   that each of the 31 masks of radius 4 keeps half the bits.
3. Masked fingerprints are the shuffle key. A bucket of two is one pair; larger ones
   are grown into forests of links in one task; a bucket too large for that is left to
   another exact way: two fingerprints within ``radius`` have a common point within
   half of it of both, so its members meet in the points around them instead.
4. Components come from those forests; no pair list is made.

Results for odd input: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; one of fewer words than a shingle has
one shingle; very long texts are read in blocks that carry the last words over, so
memory follows the block; repeated rows and equal texts share a component; a null id
never names a component unless all its rows have none; an empty table gives no rows;
other columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import text_or_empty
from veilspark.llm.components import components
from veilspark.session import materialise, ship_package

WORDS, RADIUS, SEED, BITS = 4, 4, 42, 64
BLOCK_BYTES = 1 << 20
"""Text that is cut into words at once."""
IN_TASK = 4096
"""Fingerprints of one bucket that a task compares with each other."""

_GAP = re.compile(rb"[\x09-\x0d\x20]")
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_BYTE = np.arange(8) * 256


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering family: one mask per non-zero vector of radius + 1 bits, as signed 64-bit integers."""
    vectors = (1 << (radius + 1)) - 1
    family = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() & 1)
        family.append(mask - (1 << 64) if mask >> 63 else mask)
    return family


def _blocks(raw: bytes) -> Iterator[bytes]:
    begin = 0
    while begin < len(raw):
        end = begin + BLOCK_BYTES
        gap = _GAP.search(raw, end) if end < len(raw) else None
        end = gap.start() if gap else len(raw)
        yield raw[begin:end]
        begin = end


def _hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of n words, joined by single spaces."""
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins, ends = (ends - sizes)[: len(words) - n + 1].tolist(), ends[n - 1:].tolist()
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)), np.uint64, len(begins))


def fingerprint(raw: bytes, n: int = WORDS) -> int:
    """Fingerprint of a UTF-8 text, unsigned."""
    ones, total, held = np.zeros(BITS, np.int64), 0, []
    for block in _blocks(raw):
        held += block.lower().split()  # of bytes: A to Z, and the six ASCII white-space characters
        if len(held) < n:
            continue
        found = _hashes(held, n).astype(">u8").view(np.uint8).reshape(-1, 8)
        by_byte = np.bincount((found + _BYTE).ravel(), minlength=2048).reshape(8, 256)
        ones += (by_byte @ _BIT_OF_BYTE).ravel()
        total += len(found)
        held = held[len(held) - n + 1:]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a long)."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    schema = source.select("id", F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), n) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return source.mapInArrow(run, schema)


def _distance(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member of its component) of the links among distinct fingerprints."""
    rest = np.sort(fps)
    members, roots = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            near = np.bitwise_count((rest ^ frontier.pop()).view(np.uint64)) <= radius
            if near.any():
                reached, rest = rest[near], rest[~near]
                members.append(reached)
                roots.append(np.full(len(reached), root))
                frontier.extend(reached)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def _grown(keys: DataFrame, radius: int) -> DataFrame:
    """u, v of the links inside each bucket (mask, key) of ``keys``."""

    def run(batches):
        before, held = None, []
        for batch in batches:
            mask, key, fp = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if begin == end:
                    continue
                if (mask[begin], key[begin]) != before:
                    if held:
                        yield _rows(np.concatenate(held), radius)
                    before, held = (mask[begin], key[begin]), []
                held.append(fp[begin:end])
        if held:
            yield _rows(np.concatenate(held), radius)

    by = ["mask", "key"]
    return keys.select(*by, "fp").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long")


def _rows(fps: np.ndarray, radius: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(fps, radius)], names=["u", "v"])


def _by_common_points(fps: DataFrame, radius: int) -> DataFrame:
    """u, v of the links among ``fps`` (fp, distinct): those around a point, at most 2,081 for radius 4, hang on the
    least of them."""
    points = fps.select("fp", F.col("fp").alias("point"), F.lit(-1).alias("bit"))
    found = points
    for _ in range(radius // 2):
        points = points.where(F.col("bit") < BITS - 1).select(
            "fp", "point", F.explode(F.sequence(F.col("bit") + 1, F.lit(BITS - 1))).alias("bit")
        ).select("fp", F.expr("point ^ shiftleft(1L, bit)").alias("point"), "bit")
        found = found.unionByName(points)
    met = found.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u != v").distinct()


def links(fps: DataFrame, radius: int = RADIUS, in_task: int = IN_TASK) -> DataFrame:
    """u, v: pairs that join all of ``fps`` (fp, distinct) which links of at most ``radius`` bits join, and no others."""
    if radius % 2:
        raise ValueError("the radius must be even: large buckets meet in points at half of it")
    family = masks(radius)
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in family])).alias("mask", "key"))
    buckets = materialise(
        keys.groupBy("mask", "key").agg(
            F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")
        ).where("n > 1"),
        "simhash-buckets",
    )
    pairs = buckets.where("n = 2").where(_distance("u", "v") <= radius).select("u", "v")
    some = keys.join(buckets.where(F.col("n").between(3, in_task)).select("mask", "key"), ["mask", "key"])
    many = keys.join(buckets.where(F.col("n") > in_task).select("mask", "key"), ["mask", "key"]).select("fp").distinct()
    return pairs.unionByName(_grown(some, radius)).unionByName(_by_common_points(many, radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, radius: int = RADIUS,
                    in_task: int = IN_TASK) -> DataFrame:
    """One row per document: id, fp, component_id (the least id reached over links of at most ``radius`` bits)."""
    rows = materialise(fingerprints(docs, id_col, text_col, n), "simhash-fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius, in_task)).withColumnRenamed("u", "fp")
    told = classes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = told.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows.join(told.join(named, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def hex_of(fp: str | Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Jaccard join on word n-grams by MinHash bands.

1. Every document gets band hashes and a digest of its n-gram set; documents with
   equal sets form a class, and from here on only classes are compared.
2. Band hashes are the shuffle key. The least class of a bucket is its leader;
   classes of one leader form a group, which holds every pair of its buckets.
3. A group is cut into blocks of bounded size. Each pair of blocks is one unit of
   work: it rebuilds the full n-gram sets of its texts and counts their common
   n-grams, so all links are found but no pair becomes a row. A pair that meets in
   several groups is counted in that of its least common leader.
4. Links of a block are reduced to a forest, and components are found from those.

Results for odd input: a null text counts as empty; a text without words has no
n-gram, no link and a class of its own per row; one of fewer than n words has one
n-gram; repeated rows are copies; rows with a null id get a class but never name
it unless all its rows have none; a very long text is sketched whole and makes a
block of its own; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm import wordbytes
from veilspark.llm.common import text_or_empty
from veilspark.llm.components import components
from veilspark.session import materialise, ship_package

WORDS, SIMILARITY, RECALL, MAX_HASHES = 5, 0.8, 0.999, 110
BLOCK_GRAMS = 1_000_000
"""N-grams per block; a unit of work holds two blocks, some 100 MB."""
CELLS = 2 << 20
"""Pairs of classes compared at once; short texts make many classes a block, so a unit is compared in slices of rows."""
SHARD_BYTES = 2 << 20

_U = np.uint64


def banding(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band may have so that a pair at ``similarity`` shares one with ``recall``."""
    if not 0 < similarity <= 1 or not 0 < recall < 1:
        raise ValueError("similarity and recall are shares")
    best = None
    for rows in range(1, 33):
        hit = similarity**rows
        bands = 1 if hit == 1 else np.ceil(np.log(1 - recall) / np.log1p(-hit))
        if bands * rows <= max_hashes:
            best = (int(bands), rows)
    if best is None:
        raise ValueError(f"{max_hashes} hashes do not find pairs at {similarity} with a recall of {recall}")
    return best


def _least_hashes(grams: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """count x documents: the least value of each hash function over each document's n-grams (none empty)."""
    out = np.empty((count, len(offsets)), np.uint64)
    keys = wordbytes.mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    room = np.empty_like(grams)
    for k in range(count):
        np.bitwise_xor(grams, keys[2 * k], out=room)
        np.multiply(room, keys[2 * k + 1] | _U(1), out=room)
        np.minimum.reduceat(room, offsets, out=out[k])
    return out


def _digests(grams: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest and size of each document's set of n-grams (44 bits of each)."""
    keys = np.sort((doc.astype(np.uint64) << _U(44)) | (grams >> _U(20)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    doc = (keys >> _U(44)).astype(np.int64)
    sizes = np.bincount(doc, minlength=docs)
    first = np.cumsum(sizes) - sizes
    gram = keys & _U((1 << 44) - 1)
    halves = [np.add.reduceat(wordbytes.mix(gram + _U(c)), first) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
    both = np.stack([wordbytes.mix(h + sizes.astype(np.uint64)) for h in halves], axis=1)
    return np.ascontiguousarray(both.astype(">u8")), sizes


def sketch(texts: pa.Array, n: int, bands: int, rows: int) -> tuple[list, np.ndarray, list]:
    """Digest (16 bytes, or None), set size and band hashes of each text."""
    grams, offsets = wordbytes.ngrams(wordbytes.words_of(texts), n)
    counts = np.diff(offsets)
    full = np.flatnonzero(counts)
    digests, sizes, keys = [None] * len(counts), np.zeros(len(counts), np.int64), [[]] * len(counts)
    if len(full):
        starts = offsets[:-1][full]
        least = _least_hashes(grams, starts, bands * rows).reshape(bands, rows, -1)
        hashed = np.repeat(np.arange(bands, dtype=np.uint64)[:, None] + _U(1), len(full), axis=1)
        for r in range(rows):
            hashed = wordbytes.mix(hashed * _U(0x9E3779B97F4A7C15) + least[:, r])
        digest, size = _digests(grams, np.repeat(np.arange(len(full)), counts[full]), len(full))
        hashed = hashed.T.astype(np.int64)
        for i, d in enumerate(full):
            digests[d], keys[d] = digest[i].tobytes(), hashed[i]
        sizes[full] = size
    return digests, sizes, keys


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, print (a hash that tells texts of one id, or of none, apart), text."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """id, print (of the text), cls (digest of the n-gram set, null without words), grams, bands."""
    source = _texts(docs, id_col, text_col)
    schema = source.select(
        "id", "print", F.lit(None).cast("binary").alias("cls"), F.lit(0).cast("long").alias("grams"),
        F.lit(None).cast("array<long>").alias("bands"),
    ).schema

    def run(batches):
        for shard in wordbytes.shards(batches, "text", SHARD_BYTES):
            digests, sizes, keys = sketch(shard.column(2), n, bands, rows)
            yield pa.RecordBatch.from_arrays(
                [shard.column(0), shard.column(1), pa.array(digests, pa.binary()), pa.array(sizes), pa.array(keys, pa.list_(pa.int64()))],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def leaders(classes: DataFrame) -> DataFrame:
    """cls, leader: the least class of each bucket that the class shares with another; the leader itself too."""
    keys = classes.select("cls", "grams", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("cls").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(shared, "band").groupBy("leader", "cls").agg(F.first("grams").alias("grams"))


def work(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, block_grams: int) -> DataFrame:
    """Units of work as rows: leader, i, j (blocks), side, cls, leaders, text."""
    led = materialise(leaders(classes.where(F.size("bands") > 0)), "near-leaders")
    # Written, so that a leader with very many classes can be split over tasks in the join below.
    size = materialise(led.groupBy("leader").agg(F.ceil(F.sum("grams") / block_grams).cast("int").alias("blocks")), "near-sizes")
    own = (
        led.join(size, "leader").groupBy("cls")  # a class has at most one leader per band
        .agg(F.sort_array(F.collect_list(F.struct("leader", "blocks"))).alias("groups"))
        .join(classes.select("cls", "rep", "print"), "cls")
    )
    texts = _texts(docs, id_col, text_col)
    with_text = own.join(texts, own["rep"].eqNullSafe(texts["id"]) & (own["print"] == texts["print"])).select(
        "cls", F.col("groups.leader").alias("leaders"), "groups", "text"
    )
    block = F.pmod(F.xxhash64("cls"), F.col("g.blocks")).cast("int")
    return (
        with_text.select("cls", "leaders", F.explode("groups").alias("g"), "text")
        .select("cls", "leaders", "g", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("g.blocks") - 1)).alias("o"), "text")
        .select(
            F.col("g.leader").alias("leader"), F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
            (F.col("b") > F.col("o")).cast("int").alias("side"), "cls", "leaders", "text",
        )
    )


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int, cols: int) -> np.ndarray:
    """rows x cols: how many numbers each pair shares; a and b are (row, number) without repeats."""
    out = np.zeros((rows, cols), np.float32)
    if not len(a[0]) or not len(b[0]):
        return out
    top = int(max(a[1].max(), b[1].max())) + 1
    in_a, in_b = np.bincount(a[1], minlength=top), np.bincount(b[1], minlength=top)
    pairs = in_a * in_b
    rare, often = (pairs > 0) & (pairs <= 64), pairs > 64
    # Rare numbers: list their few pairs. Frequent ones: a product of 0/1 matrices.
    if rare.any():
        ra, rb = rare[a[1]], rare[b[1]]
        xa, na = a[0][ra], a[1][ra]
        by = np.argsort(b[1][rb], kind="stable")
        xb, nb = b[0][rb][by], b[1][rb][by]
        lo = np.searchsorted(nb, na)
        many = in_b[na]
        left = np.repeat(xa, many)
        right = xb[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        out += np.bincount(left * cols + right, minlength=rows * cols).reshape(rows, cols).astype(np.float32)
    number = np.cumsum(often) - 1
    fa, fb = often[a[1]], often[b[1]]
    ia, ca, ib, cb = a[0][fa], number[a[1][fa]], b[0][fb], number[b[1][fb]]
    width = max(1, min(2048, CELLS // max(rows, cols)))
    for begin in range(0, int(often.sum()), width):
        wa, wb = (ca >= begin) & (ca < begin + width), (cb >= begin) & (cb < begin + width)
        ma, mb = np.zeros((rows, width), np.float32), np.zeros((cols, width), np.float32)
        ma[ia[wa], ca[wa] - begin] = 1
        mb[ib[wb], cb[wb] - begin] = 1
        out += ma @ mb.T
    return out


def _sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram) pairs without repeats, and each set's size."""
    grams, offsets = wordbytes.ngrams(wordbytes.words_of(pa.array(texts, pa.large_string())), n)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    by = np.lexsort((grams, doc))
    doc, grams = doc[by], grams[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return doc, grams, np.bincount(doc, minlength=len(texts))


def _united(root: np.ndarray, linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """``root`` (least member of each node's component) after linked[x, y] has joined rows[x] and cols[y]."""
    n = len(root)
    while True:
        old = root.copy()
        of_cols = np.where(linked, root[cols].astype(np.int32)[None, :], np.int32(n)).min(axis=1, initial=n)
        np.minimum.at(root, old[rows], of_cols)
        of_rows = np.where(linked, root[rows].astype(np.int32)[:, None], np.int32(n)).min(axis=0, initial=n)
        np.minimum.at(root, old[cols], of_rows)
        while (root[root] != root).any():
            root = root[root]
        if (root == old).all():
            return root


def _slice(pairs: tuple[np.ndarray, np.ndarray], begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows begin to end of (row, number), which is sorted by row."""
    lo, hi = np.searchsorted(pairs[0], [begin, end])
    return pairs[0][lo:hi] - begin, pairs[1][lo:hi]


def verify(leader: bytes, side: list[int], cls: list[bytes], lead: list[list[bytes]], texts: list[str], across: bool,
           n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one unit of work: links counted per class, and each class's root among the links found here."""
    doc, grams, size = _sets(texts, n)
    _, number = np.unique(grams, return_inverse=True)
    side_of = np.array(side)
    rows = np.flatnonzero(side_of == 0)
    cols = np.flatnonzero(side_of == 1) if across else rows
    place = np.zeros(len(cls), np.int64)

    def of(which: np.ndarray, owner: np.ndarray, numbers: np.ndarray):
        place[which] = np.arange(len(which))
        mine = np.isin(owner, which) if across else np.ones(len(owner), bool)
        return place[owner[mine]], numbers[mine]

    in_rows, in_cols = of(rows, doc, number), of(cols, doc, number)
    # Pairs that also meet under a smaller leader are counted there.
    smaller = [(i, x) for i, xs in enumerate(lead) for x in xs if x < leader]
    if smaller:
        owner = np.array([i for i, _ in smaller])
        _, ids = np.unique(np.array([x for _, x in smaller], dtype="S16"), return_inverse=True)
        led_rows, led_cols = of(rows, owner, ids), of(cols, owner, ids)
    count, roots = np.zeros(len(cls), np.int64), np.arange(len(cls))
    step = max(1, CELLS // max(1, len(cols)))
    for begin in range(0, len(rows), step):
        part = rows[begin: begin + step]
        end = begin + len(part)
        shared = _common(_slice(in_rows, begin, end), in_cols, len(part), len(cols))
        total = size[part][:, None] + size[cols][None, :]
        linked = shared.astype(np.float64) * (1 + similarity) >= similarity * total - 1e-6
        if not across:
            linked[np.arange(len(part)), np.arange(begin, end)] = False
        roots = _united(roots, linked, part, cols)
        if smaller:
            linked &= _common(_slice(led_rows, begin, end), led_cols, len(part), len(cols)) == 0
        count[part] += linked.sum(axis=1)
        if across:
            count[cols] += linked.sum(axis=0)
    return count, roots


def _units(batches: Iterator[pa.RecordBatch]):
    """Rows of one (leader, i, j) at a time, from rows sorted by it."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if held:
                    yield key, held
                key, held = row[:3], []
            held.append(row[3:])
    if held:
        yield key, held


def links(units: DataFrame, n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """cls, n_links, root: what each unit of work found about each of its classes."""

    def run(batches):
        for (leader, i, j), rows in _units(batches):
            seen: dict[bytes, tuple] = {}
            for row in rows:  # repeated ids may bring a text of another class; keep the class's own, once
                side, cls, lead, text = row
                if cls not in seen:
                    if sketch(pa.array([text]), n, 1, 1)[0][0] == cls:
                        seen[cls] = row
            if len(seen) < 2:
                continue
            side, cls, lead, texts = (list(x) for x in zip(*seen.values(), strict=True))
            if i != j and len(set(side)) < 2:
                continue
            count, roots = verify(leader, side, cls, lead, texts, i != j, n, similarity)
            told = np.flatnonzero((count > 0) | (roots != np.arange(len(roots))))
            if len(told):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cls[t] for t in told], pa.binary()), pa.array(count[told]),
                     pa.array([cls[roots[t]] for t in told], pa.binary())], names=["cls", "n_links", "root"],
                )

    by = ["leader", "i", "j"]
    return units.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "cls binary, n_links long, root binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
         similarity: float = SIMILARITY, recall: float = RECALL, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per document: id, class_id, copy_of, n_copies, n_links.

    ``class_id`` is the least id of all documents reached over links, ``copy_of``
    the least id with the same n-gram set, ``n_links`` the number of other sets
    with at least ``similarity``.
    """
    ship_package(docs.sparkSession)
    bands, rows = banding(similarity, recall)
    sketched = materialise(sketches(docs, id_col, text_col, n, bands, rows), "near-sketches")
    classes = materialise(
        sketched.where("cls IS NOT NULL").groupBy("cls").agg(
            F.min("id").alias("rep"), F.coalesce(F.min_by("print", "id"), F.min("print")).alias("print"),  # null ids name none
            F.count(F.lit(1)).alias("n_copies"), F.first("grams").alias("grams"),
            F.first("bands").alias("bands"),
        ),
        "near-classes",
    )
    found = materialise(links(work(classes, docs, id_col, text_col, block_grams), n, similarity), "near-links")
    roots = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    told = (
        classes.select("cls", "rep", "n_copies").join(counts, "cls", "left")
        .join(roots.withColumnRenamed("u", "cls"), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    ids = told.groupBy("root").agg(F.min("rep").alias("class_id"))
    told = told.join(ids, "root").select("cls", "rep", "n_copies", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return sketched.select("id", "cls").join(told, "cls", "left").select(
        "id", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("rep")).alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )

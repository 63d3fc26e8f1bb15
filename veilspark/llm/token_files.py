"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Every id is stored as its rank in the corpus, the most frequent id first, in one
to four bytes. The lengths, two bits each, stand apart in control bytes, four ids
a byte; a table lookup turns control bytes into lengths, so a document is decoded
with a handful of array operations.

A file set is a folder with ``ranks`` (id, rank) and ``documents`` in ascending
id order: shard, doc, n_ids, control, data. Shards are ranges of the id, one
Spark partition each, so writing needs no single task.

Results for odd input: null and empty texts have the end id alone; null ids come
first; rows that share an id follow each other in some fixed order, that of the
files; a very long text is encoded whole and is one row of its file; an empty
table gives an empty file set; other columns are not used.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm.chunk_table import ChunkTable
from veilspark.llm.common import buckets_for
from veilspark.session import shared_dir, ship_package

BATCH_CHARS = 1 << 20
BATCH_IDS = 500_000
"""Text, and ids, that a task works on at once, unless one document has more."""
SHARD_IDS = 16_000_000
"""Ids per range partition and so per file: some 25 MB."""

_PACKED = ["n_ids", "control", "data"]
# White space that is no plain space or line feed, as Unicode has it, and four control characters besides.
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
_NEAR = ("  ", " \n", "\n ", "\n\n", "\0")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else one from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


@cache
def _table(path: str) -> ChunkTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    kind = json.loads(tok.to_str())
    before = kind["pre_tokenizer"] or {}
    if kind["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
        raise ValueError("not a byte-level tokenizer that leaves texts as they are")
    bare = Tokenizer(tok.model)  # the same merges, for words that need no further splitting
    letters = _byte_letters()
    gap, feed = letters[0], letters[ord("\n")]
    feed_id = tok.token_to_id(feed)

    def encode(parts: list[str]) -> list[list[int]]:
        plain = [i for i, c in enumerate(parts) if _one_word(c)]
        out: list = [None] * len(parts)
        if plain:
            joined = "\0".join([parts[i] for i in plain]).encode().decode("latin-1").translate(letters)
            words = [x for word in joined.split(gap) for x in (word, feed)]  # a line feed is no part of a word
            ids = bare.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids
            begin = 0
            for i, end in zip(plain, np.flatnonzero(np.array(ids) == feed_id).tolist(), strict=True):
                out[i] = ids[begin:end]
                begin = end + 1
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, tok.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    return ChunkTable(encode)


def _one_word(chunk: str) -> bool:
    """Latin letters after at most one space: a single word for the tokenizer's pattern."""
    return (chunk[1:] if chunk[0] == " " else chunk).isalpha() and max(chunk) < "\u0250"


def _lone_mark(text: str) -> bool:
    """Does a full stop or comma follow another character than a letter or digit?"""
    first, *rest = text.replace(",", ".").split(".")
    if not rest:
        return False
    return (first != "" and not first[-1].isalnum()) or not all([p[-1:].isalnum() for p in rest[:-1]])


def chunks(text: str) -> list[str]:
    """Parts of a text that a byte-level tokenizer treats apart.

    Its pattern takes runs of letters, of digits or of other marks, each with one
    space before it, and white space. So a lone space or line feed is a border, and
    so is the place before a full stop or comma that follows a letter or digit.
    """
    if not text:
        return []
    odd = _ODD if not text.isascii() else _ODD[:8]
    if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _NEAR) or any(x in text for x in odd):
        return [text]
    if "<|" not in text and not _lone_mark(text):
        text = text.replace(",", "\0,").replace(".", "\0.")
    parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return parts if parts[0] else parts[1:]  # a text may begin with a mark


def pack(ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """n_ids, control and data of documents, whose ids (below 2**32) follow each other."""
    size = np.ones(len(ids), np.int8)
    for k in (1, 2, 3):
        size += ids >= 1 << 8 * k
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    data = np.empty(at[-1], np.uint8)
    data[at[:-1]] = ids & 0xFF
    for k in (1, 2, 3):
        long = np.flatnonzero(size > k)
        data[at[long] + k] = (ids[long] >> 8 * k) & 0xFF
    # Control bytes of a document begin anew, so its last one may be partly unused.
    controls = np.concatenate([[0], np.cumsum(-(-counts // 4))])
    ends = np.concatenate([[0], np.cumsum(counts)])
    two_bits = np.zeros(4 * controls[-1], np.uint8)
    two_bits[_inside(controls, counts)] = size - 1
    four = two_bits.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return [pa.array(counts), _binary(controls, control), _binary(at[ends], data)]


def _inside(controls: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each id's two bits are, among four for every control byte."""
    return np.repeat(4 * controls[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())]
    )


_SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int8)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins and the last ends."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0]: ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def unpack(counts: np.ndarray, control: pa.Array, data: pa.Array) -> np.ndarray:
    """The ids of documents, one document after the other: a table lookup of the control bytes, then four gathers."""
    bits, begins = _bytes_of(control)
    size = _SIZES[bits].ravel()[_inside(begins, counts)]
    raw, _ = _bytes_of(data)
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate([raw, np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(size > k)
        out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _parts(batch: pa.RecordBatch):
    """Slices of a batch that has the columns of _PACKED, each with counts and ids; about BATCH_IDS at once."""
    n, control, data = (batch.schema.get_field_index(c) for c in _PACKED)
    counts = batch.column(n).to_numpy()
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(counts):
        done = ends[begin - 1] if begin else 0
        upto = max(begin + 1, int(np.searchsorted(ends, done + BATCH_IDS, side="right")))
        part = batch.slice(begin, upto - begin)
        yield part, counts[begin:upto], unpack(counts[begin:upto], part.column(control), part.column(data))
        begin = upto


def _schema(rows: DataFrame, *keep: str):
    return rows.select(
        *keep, F.lit(0).cast("long").alias("n_ids"), F.lit(b"").alias("control"), F.lit(b"").alias("data")
    ).schema


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc, n_ids, control, data: the ids of every text and the end id, packed as they are."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema = _schema(rows, "doc")

    def run(batches):
        table = _table(tokenizer)
        for batch in batches:
            whole, begin = batch.column(1).to_pylist(), 0
            while begin < len(batch):
                texts, size = [], 0
                while begin + len(texts) < len(batch) and size < BATCH_CHARS:
                    texts.append(whole[begin + len(texts)] or "")
                    size += len(texts[-1])
                ids, counts = table.ids([chunks(t) for t in texts])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                kept = batch.column(0).slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([kept, *pack(ids, counts + 1)], names=schema.names)
                begin += len(texts)

    return rows.mapInArrow(run, schema)


def id_counts(coded: DataFrame) -> DataFrame:
    """id, n of every id that occurs; each task sends one row per distinct id."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, ids in _parts(batch):
                n = np.bincount(ids)
                if len(n) > len(total):
                    total, n = n, total
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return coded.select(_PACKED).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _ranked(rows: DataFrame, lookup: np.ndarray) -> DataFrame:
    """doc and the ranks of its ids, packed; the lookup is bounded by the vocabulary."""
    shared = rows.sparkSession.sparkContext.broadcast(lookup)
    schema = _schema(rows, "doc")

    def run(batches):
        lookup = shared.value
        for batch in batches:
            for part, counts, ids in _parts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *pack(lookup[ids], counts)], names=schema.names)

    return rows.select("doc", *_PACKED).mapInArrow(run, schema)


def _ranks(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.parquet(f"{folder}/ranks").select("id", "rank").collect()  # bounded by the vocabulary
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def write(coded: DataFrame, folder: str) -> None:
    """Write the file set of ``coded`` (from ``encode``), which is read three times and so should be a stored table."""
    spark = coded.sparkSession
    order = W.orderBy(F.desc("n"), "id")  # as many rows as the vocabulary has ids
    ranks = id_counts(coded).select("id", (F.row_number().over(order) - 1).alias("rank"))
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")
    ids, rank = _ranks(spark, folder)
    lookup = np.zeros(int(ids.max(initial=-1)) + 1, np.uint32)
    lookup[ids] = rank
    total = coded.agg(F.sum("n_ids")).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, buckets_for(total, SHARD_IDS))
    (
        _ranked(coded, lookup).repartitionByRange(shards, "doc").sortWithinPartitions("doc")
        .withColumn("shard", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
        .write.option("compression", "zstd").parquet(f"{folder}/documents")
    )


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The files: shard, place (in the order of the files), doc, n_ids, and ranks as control and data."""
    return spark.read.parquet(f"{folder}/documents")


def id_of_rank(spark: SparkSession, folder: str) -> np.ndarray:
    ids, rank = _ranks(spark, folder)
    lookup = np.zeros(len(ids), np.uint32)
    lookup[rank] = ids
    return lookup


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """place, start: how many ids all documents before it have."""
    rows = stored(spark, folder).select("shard", "place", "n_ids")
    sums = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per file
    before = sums.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    upto = W.partitionBy("shard").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.select("shard", "place", (F.sum("n_ids").over(upto) - F.col("n_ids")).alias("inside"))
    return inside.join(before, "shard").select("place", (F.col("inside") + F.col("before")).alias("start"))


def unpacked(rows: DataFrame, *keep: str, lookup: np.ndarray | None = None) -> DataFrame:
    """``keep`` and ids, an array of a document's numbers, each replaced by lookup[number] if there is a lookup."""
    schema = rows.select(*keep, F.lit(None).cast("array<bigint>").alias("ids")).schema
    shared = rows.sparkSession.sparkContext.broadcast(lookup)

    def run(batches):
        for batch in batches:
            for part, counts, ids in _parts(batch):
                ids = ids if shared.value is None else shared.value[ids]
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), lists], names=schema.names)

    return rows.select(*keep, *_PACKED).mapInArrow(run, schema)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """place, doc, n_ids and crc32 of the files' documents: the CRC-32 of the ids as little-endian unsigned 32-bit
    integers."""
    rows = stored(spark, folder).select("place", "doc", *_PACKED)
    schema = rows.select("place", "doc", "n_ids", F.lit(0).cast("long").alias("crc32")).schema
    shared = spark.sparkContext.broadcast(id_of_rank(spark, folder).astype("<u4"))

    def run(batches):
        for batch in batches:
            for part, counts, ranks in _parts(batch):
                raw = memoryview(shared.value[ranks]).cast("B")
                ends = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts), pa.array(crc, pa.int64())], names=schema.names
                )

    return rows.mapInArrow(run, schema)


def encoded_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> str:
    """Encode ``docs`` and write a file set; returns its folder."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")
    raw = f"{folder}/unranked"
    encode(docs, tokenizer, **options).write.option("compression", "zstd").parquet(raw)
    write(spark.read.parquet(raw), folder)
    return folder

"""Benchmark decontamination by suffix arrays over the training texts.

The documents of a task are cut into shards of bounded size. Each shard gets a
suffix array over all its words; every suffix of every benchmark item is looked
up by binary search, which gives all places where its first 13 words stand and
the longest match. No text is shuffled and no document meets another. The
benchmark is hashed by Spark into a table in the shared folder; tasks read that
table in blocks of bounded size, so the documents are read in one pass however
large it is, and nothing of it goes through the driver.

Results for odd input: a null text has no words and is clean; an item without
words never matches; an item of fewer than 13 words is one window; repeated rows
and items each count; an empty table on either side gives rows without hits or
no rows; a null id is kept; a very long text makes a shard of its own; other columns are
kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import suffix_array, wordbytes
from veilspark.llm.common import text_or_empty
from veilspark.session import shared_dir, ship_package

WINDOW = 13
SHARD_BYTES = 3 << 20
"""Text per suffix array: about half a million words, some 30 MB while it is built."""
PLACES = 1 << 20
"""Pairs of a window and a place in the shard that are expanded at once, unless one item alone has more."""
BLOCK_BYTES = 24 << 20
"""Hashed benchmark words, 8 bytes each, that a task holds at once. A task keeps a benchmark of one block, and reads a
larger one again for each of its shards."""

_STATE = [
    ("n_words", "bigint"),
    ("hits", "array<struct<from:bigint,to:bigint>>"),
    ("items", "array<string>"),
    ("longest", "struct<words:bigint,item:string,at:bigint>"),
]


class Block:
    """Some benchmark items as one array of word hashes, each item ended by a 0."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self._fill(ids, wordbytes.words_of(pa.array(texts, pa.large_string())), window)

    @classmethod
    def of_hashes(cls, ids: list[str], hashes: list[bytes], window: int) -> Block:
        """Of items whose words are hashed already."""
        arrays = [np.frombuffer(h, np.uint64) for h in hashes]
        first = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
        block = cls.__new__(cls)
        block._fill(ids, wordbytes.Words(np.concatenate([np.zeros(0, np.uint64), *arrays]), first), window)
        return block

    def _fill(self, ids: list[str], words: wordbytes.Words, window: int) -> None:
        self.hashes, self.begins = suffix_array.with_ends(words)
        self.ids = np.array(ids, dtype=object)
        self.item = np.repeat(np.arange(len(ids)), words.counts + 1)
        left = np.repeat(words.counts, words.counts + 1) - (
            np.arange(len(self.hashes)) - np.repeat(self.begins, words.counts + 1)
        )
        whole = np.repeat(words.counts, words.counts + 1)
        #: Words of the window that starts at each place; 0 where none does.
        self.need = np.where(left >= window, window, np.where((whole < window) & (left == whole), whole, 0))


def _slices(block: Block, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the block, cut between items, whose windows stand in about PLACES places of the shard together."""
    ends = np.append(block.begins[1:], len(block.hashes))  # of each item
    upto = np.cumsum(np.append(0, sizes))[ends]
    begin = done = 0
    while begin < len(block.hashes):
        item = max(np.searchsorted(upto, done + PLACES, side="right") - 1, np.searchsorted(ends, begin, side="right"))
        yield begin, int(ends[item])
        begin, done = int(ends[item]), upto[item]


def _places(sa: suffix_array.SuffixArray, block: Block, lo: np.ndarray, hi: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the block, place in the shard) of every window from ``begin`` on that occurs, confirmed word by word."""
    sizes = hi - lo
    suffix = begin + np.repeat(np.arange(len(lo)), sizes)
    at = sa.order[np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    same = np.ones(len(at), bool)
    need = block.need[suffix]
    for k in range(int(need.max(initial=0))):
        inside = np.flatnonzero(same & (need > k))
        same[inside] = sa.hashes[at[inside] + k] == block.hashes[suffix[inside] + k]
    return suffix[same], at[same]


def _runs(sorted_from: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges that are sorted by their start."""
    reach = np.maximum.accumulate(upto)
    new = np.ones(len(upto), bool)
    new[1:] = sorted_from[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(upto) - 1)
    return sorted_from[new], reach[last]


def scan_shard(texts: pa.Array, blocks: Block | Iterable[Block], window: int) -> list[dict]:
    """Per document of the shard: n_words, hits (merged word ranges), items, longest."""
    words = wordbytes.words_of(texts)
    out = [{"n_words": int(n), "hits": [], "items": [], "longest": None} for n in words.counts]
    if not len(words.hashes):
        return out
    sa = suffix_array.build(words, window)
    for block in [blocks] if isinstance(blocks, Block) else blocks:
        if not len(block.hashes):
            continue
        lo, hi, _ = sa.search(block.hashes, block.need)
        for begin, end in _slices(block, hi - lo):
            suffix, at = _places(sa, block, lo[begin:end], hi[begin:end], begin)
            if len(at):
                for doc, found in _by_document(words, block, suffix, at):
                    out[doc] = _merged(out[doc], found | {"n_words": out[doc]["n_words"]})
    return out


def _by_document(words: wordbytes.Words, block: Block, suffix: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, dict]]:
    """(document, its hits, items and longest match) out of places in the block and in the shard."""
    begins = words.first[:-1] + np.arange(len(words.counts))
    doc = np.searchsorted(begins, at, side="right") - 1
    at = at - begins[doc]
    # Hits on one diagonal (same item, same shift) that follow each other are one longer match.
    item = block.item[suffix]
    by = np.lexsort((at, suffix - at, item, doc))
    doc, item, at, suffix = doc[by], item[by], at[by], suffix[by]
    need = block.need[suffix]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(suffix - at) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(at) - 1)
    begin, end, doc, item = at[first], at[last] + need[last], doc[first], item[first]
    by = np.lexsort((begin, doc))
    begin, end, doc, item = begin[by], end[by], doc[by], item[by]
    bounds = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        best = a + int(np.argmax(end[a:b] - begin[a:b]))
        yield int(doc[a]), {
            "hits": list(zip(*(x.tolist() for x in _runs(begin[a:b], end[a:b])), strict=True)),
            "items": sorted(block.ids[np.unique(item[a:b])]),
            "longest": (int(end[best] - begin[best]), block.ids[item[best]], int(begin[best])),
        }


def _merged(old: dict, new: dict) -> dict:
    """State of a document after some more items of the benchmark."""
    if not new["hits"]:
        return old
    if not old["hits"]:
        return new
    ranges = sorted(old["hits"] + new["hits"])
    begin, end = _runs(np.array([r[0] for r in ranges]), np.array([r[1] for r in ranges]))
    return {
        "n_words": new["n_words"],
        "hits": list(zip(begin.tolist(), end.tolist(), strict=True)),
        "items": sorted(old["items"] + new["items"]),  # an item is looked up once
        "longest": max(old["longest"], new["longest"], key=lambda x: x[0]),
    }


def _hashed(benchmark: DataFrame, id_col: str, text_col: str) -> str:
    """Folder of a table (id, hashes) with the word hashes of every item."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        for part in wordbytes.shards(batches, "text", SHARD_BYTES):
            words = wordbytes.words_of(part.column(1))
            hashes = [words.hashes[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.binary())], names=["id", "hashes"])

    path = shared_dir(benchmark.sparkSession, "benchmark")
    rows.mapInArrow(run, "id string, hashes binary").write.parquet(path)
    return path


def _blocks(folder: str, window: int, room: int) -> Iterator[Block]:
    """The items of a hashed table, a bounded block at a time (one longer item makes its own block)."""
    from pyarrow import dataset, fs

    store, root = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder if ":" in folder else f"file:{folder}"))
    ids, hashes, size = [], [], 0
    for batch in dataset.dataset(root, format="parquet", filesystem=store).to_batches(batch_size=256):
        for i, h in zip(batch.column("id").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            if ids and size + len(h) > room:
                yield Block.of_hashes(ids, hashes, window)
                ids, hashes, size = [], [], 0
            ids.append(i)
            hashes.append(h)
            size += len(h)
    yield Block.of_hashes(ids, hashes, window)


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
            block_bytes: int = BLOCK_BYTES, out_col: str = "leak") -> DataFrame:
    """The rows of ``docs`` with a struct ``leak``: n_words, hits, items, longest (words, item, word offset).

    A column of ``docs`` with that name, in any case, would be replaced: name another with ``out_col``.
    """
    ship_package(docs.sparkSession)
    folder = _hashed(benchmark, item_id, item_text)
    leak = "struct<" + ",".join(f"{n}:{t}" for n, t in _STATE) + ">"
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() != out_col.lower()])
    schema = kept.withColumn(out_col, F.lit(None).cast(leak)).schema
    kind = _arrow_state()

    def run(batches):
        only: Block | None = None
        for shard in wordbytes.shards(batches, text_col, shard_bytes):
            texts = shard.column(shard.schema.get_field_index(text_col))
            texts = texts.fill_null("") if texts.null_count else texts
            seen: list[Block] = []

            def read():
                for block in _blocks(folder, window, block_bytes):
                    seen.append(block if not seen else None)  # of a benchmark of many blocks none is kept
                    yield block

            found = scan_shard(texts, only or read(), window)
            if len(seen) == 1:
                only = seen[0]
            state = pa.array(
                [{"n_words": f["n_words"], "hits": [{"from": a, "to": b} for a, b in f["hits"]], "items": f["items"],
                  "longest": None if f["longest"] is None else dict(zip(("words", "item", "at"), f["longest"], strict=True))}
                 for f in found], kind,
            )
            yield pa.RecordBatch.from_arrays([*shard.columns, state], names=schema.names)

    return kept.mapInArrow(run, schema)


def _arrow_state() -> pa.DataType:
    whole = pa.int64()
    return pa.struct([
        ("n_words", whole), ("hits", pa.list_(pa.struct([("from", whole), ("to", whole)]))), ("items", pa.list_(pa.string())),
        ("longest", pa.struct([("words", whole), ("item", pa.string()), ("at", whole)])),
    ])


def n_hit(leak: str = "leak"):
    """Words inside any occurrence of a window."""
    return F.aggregate(f"{leak}.hits", F.lit(0).cast(T.LongType()), lambda s, h: s + h["to"] - h["from"])


def contaminated(leak: str = "leak"):
    """The rule for removal: some words are hit, and they are at least a twentieth of all."""
    return (n_hit(leak) > 0) & (20 * n_hit(leak) >= F.col(f"{leak}.n_words"))

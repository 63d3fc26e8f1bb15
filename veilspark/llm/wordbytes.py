"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes.

A word is a maximal run of ASCII letters (lower-cased), ASCII digits and
characters beyond ASCII. Word and n-gram identities are 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1

_LOWER = np.zeros(256, np.uint8)  # 0 where a byte is no part of a word
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _LOWER[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _LOWER[_b] = _b + 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def _powers(n: int, base: int = _P) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass(frozen=True)
class Words:
    """``hashes`` of all words in order; document d has the words first[d] to first[d + 1]."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(column: pa.Array) -> Words:
    """Words of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    n = len(data)
    low = _LOWER[data]
    inside = np.zeros(n + 1, bool)
    inside[:-1] = low != 0
    # A document's first byte starts a word even if the text before it ends in one.
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    at = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts_here[at] = inside[at]
    starts = np.flatnonzero(starts_here)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64))
    # Separators count as zero, so each sum from start to start is that of one word.
    span = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, span)
    longest = int(span.max())
    value = low[starts[0]:].astype(np.uint64) * _powers(longest)[place]
    hashes = mix(np.add.reduceat(value, starts - starts[0]))
    return Words(hashes, np.searchsorted(starts, bounds).astype(np.int64))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams and each document's offsets into them.

    A document of fewer words, but not none, has one n-gram: all its words.
    """
    h, first, counts = words.hashes, words.first, words.counts
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    power = _powers(n, 0xD6E8FEB86659FD93)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    rolled = np.zeros(len(h), np.uint64)
    for k in range(n):
        rolled += padded[k: k + len(h)] * power[k]
    at = np.repeat(first[:-1] - offsets[:-1], sizes) + np.arange(offsets[-1])
    out = rolled[at]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        own = h[first[d]: first[d + 1]]
        out[offsets[d]] = (own * power[: len(own)]).sum(dtype=np.uint64) + _U(len(own))
    return mix(out), offsets


def shards(batches: Iterator[pa.RecordBatch], text: str, room: int) -> Iterator[pa.RecordBatch]:
    """Regroup Arrow batches so that each has about ``room`` bytes of text, or one longer document, and under
    2**20 rows."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    try:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
            begin = 0
            while begin < len(batch):
                upto = int(np.searchsorted(ends, ends[begin] + (room - size), side="right")) - 1
                upto = min(max(upto, begin + 1), len(batch))
                held.append(batch.slice(begin, upto - begin))
                size += int(ends[upto] - ends[begin])
                rows += upto - begin
                begin = upto
                if size >= room or rows >= 1 << 19 or begin < len(batch):
                    yield _one(held)
                    held, size, rows = [], 0, 0
        if held:
            yield _one(held)
    finally:
        held = []
        release()


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and waits beside other stages' workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

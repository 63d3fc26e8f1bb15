"""Distinct-chunk tables: each distinct chunk of a text is encoded once, its ids are joined back by position.

A tokenizer whose pieces never cross certain borders gives the same ids for the
chunks between them as for the whole text. Texts become chunk numbers, and ids
are gathered from a pool. A table lives as long as a Python worker. When it holds more
than ``room`` chunks, only the ``keep`` first stay; chunks over ``LONG`` characters (a
text without borders is one) are encoded where they occur and never kept. So its memory
is bounded in characters, too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain, islice, repeat

import numpy as np

ROOM, KEEP, SLICE = 1_400_000, 700_000, 2_000
"""Chunks that a table may hold (some 330 MB), those that stay when it is full, and those encoded in one call."""


LONG = 200


class ChunkTable:
    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], room: int = ROOM, keep: int = KEEP):
        self.encode, self.room, self.keep = encode, room, keep
        self.number: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 12, np.int64)  # of each chunk's ids in the pool, and the end of the last

    def shrink(self, keep: int) -> None:
        """Keep the chunks met first, which are the frequent ones."""
        if len(self.number) <= keep:
            return
        self.number = dict(islice(self.number.items(), keep))
        self.start = self.start[: keep + 1].copy()
        self.pool = self.pool[: max(1, self.start[-1])].copy()

    def _add(self, missing: list[str]) -> None:
        for a in range(0, len(missing), SLICE):
            part = missing[a: a + SLICE]
            encoded = self.encode(part)
            base = len(self.number)
            begin = self.start[base]
            ends = begin + np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))
            self.pool = _room(self.pool, ends[-1])
            self.pool[begin: ends[-1]] = np.fromiter(chain.from_iterable(encoded), np.int32)
            self.start = _room(self.start, base + len(part) + 1)
            self.start[base + 1: base + len(part) + 1] = ends
            self.number.update(zip(part, range(base, base + len(part)), strict=True))

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as chunks, one after the other, and how many each text has."""
        if len(self.number) > self.room:
            self.shrink(self.keep)
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = list(chain.from_iterable(texts))
        at = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(at < 0)
        long: list[str] = []
        if len(new):
            missing = [flat[i] for i in new.tolist()]
            distinct = list(dict.fromkeys(missing))
            long = [c for c in distinct if len(c) > LONG]
            self._add([c for c in distinct if len(c) <= LONG] if long else distinct)
            self._add(long)  # last, for they go again
            at[new] = np.fromiter(map(self.number.__getitem__, missing), np.int64, len(missing))
        start = self.start[at]
        size = self.start[at + 1] - start
        ends = np.cumsum(size)
        out = self.pool[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        for c in long:
            del self.number[c]
        used = int(self.start[len(self.number)])
        if len(self.pool) > 4 * used + (1 << 20):  # a very long text has gone
            self.pool = self.pool[: 2 * used + (1 << 16)].copy()
        last = np.cumsum(counts)
        ends = np.concatenate([[0], ends])
        return out, ends[last] - ends[last - counts]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """``array``, or a copy at least twice as long, with room for ``size`` items."""
    if size <= len(array):
        return array
    out = np.zeros(max(int(size), 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out

"""Suffix arrays over the words of one shard of documents.

Suffixes are ordered by 21-bit word numbers, three of them packed in one 64-bit
key, so the first sort settles three words and later sorts touch ties only.
Searching narrows an interval of the array three words at a time, for all test
suffixes at once. A match found this way is confirmed with the 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from veilspark.llm.wordbytes import Words

_BITS = 21
_STEP = 3


def _numbers(hashes: np.ndarray) -> np.ndarray:
    """1 to 2**21 - 1; 0 marks the end of a document."""
    return np.maximum(hashes >> np.uint64(64 - _BITS), np.uint64(1)).astype(np.int64)


def _packed(numbers: np.ndarray) -> np.ndarray:
    n = len(numbers)
    padded = np.concatenate([numbers, np.zeros(_STEP, np.int64)])
    return (padded[:n] << (2 * _BITS)) | (padded[1: n + 1] << _BITS) | padded[2: n + 2]


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one 0 after each document, and where each document begins."""
    docs = len(words.first) - 1
    begins = words.first[:-1] + np.arange(docs)
    out = np.zeros(len(words.hashes) + docs, np.uint64)
    keep = np.ones(len(out), bool)
    keep[begins + words.counts] = False
    out[keep] = np.maximum(words.hashes, np.uint64(1))
    return out, begins


@dataclass(frozen=True)
class SuffixArray:
    """``order``: start places of all suffixes of ``hashes``, sorted to ``depth`` words; ``heads``: their keys."""

    hashes: np.ndarray
    keys: np.ndarray
    order: np.ndarray
    heads: np.ndarray
    depth: int

    def search(self, query: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every suffix of ``query``: the interval of places that share its first ``need`` words, and
        how many words its longest match has, as far as the array is sorted.

        ``need`` is 0 where a suffix is not to be searched. Matches go by word
        numbers here; a suffix stops at the 0 that ends its item.
        """
        numbers = np.where(query == 0, 0, _numbers(query))
        packed = np.concatenate([_packed(numbers), np.zeros(1, np.int64)])
        n = len(query)
        left = _words_left(numbers)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        found_lo, found_hi, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live, depth = np.flatnonzero(need > 0), 0
        while len(live) and depth < self.depth:
            ends, more = None, live
            for take in (1, 2, 3):  # the interval after one, two and three more words
                more = more[left[more] >= depth + take]
                a, b = self._narrow(packed[more + depth], take, depth, lo[more], hi[more])
                hit = b > a
                more, a, b = more[hit], a[hit], b[hit]
                longest[more] = depth + take
                exact = need[more] == depth + take
                found_lo[more[exact]], found_hi[more[exact]] = a[exact], b[exact]
                ends = (a, b)
            lo[more], hi[more] = ends
            live, depth = more, depth + _STEP
        return found_lo, found_hi, longest

    def _narrow(self, key, take, depth, lo, hi):
        shift = _BITS * (_STEP - take)
        low = (key >> shift) << shift
        if depth == 0:
            return np.searchsorted(self.heads, low), np.searchsorted(self.heads, low + (1 << shift))
        return self._bisect(low, depth, lo, hi), self._bisect(low + (1 << shift), depth, lo, hi)

    def _bisect(self, wanted, depth, lo, hi):
        """First place in [lo, hi) whose key at ``depth`` is not below ``wanted``, for all rows together."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.keys[np.minimum(self.order[mid] + depth, len(self.keys) - 1)] < wanted[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]


def _words_left(numbers: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its item."""
    ends = np.flatnonzero(numbers == 0)
    place = np.arange(len(numbers))
    return ends[np.searchsorted(ends, place)] - place if len(ends) else np.zeros(0, np.int64)


def build(words: Words, depth: int) -> SuffixArray:
    """Array over all suffixes of a shard, in order up to ``depth`` words (rounded up to threes)."""
    hashes, _ = with_ends(words)
    keys = _packed(np.where(hashes == 0, 0, _numbers(hashes)))
    order = np.argsort(keys)
    heads = sorted_keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    tied, reach = np.arange(len(order)), _STEP
    while reach < depth:
        # Suffixes that still share all words so far with a neighbour, and have words left.
        group = np.cumsum(new) - 1
        alone = new & np.append(new[1:], True)
        keep = ~alone & (sorted_keys & ((1 << _BITS) - 1) != 0)
        tied, group = tied[keep], group[keep]
        if not len(tied):
            reach = len(keys) + depth  # in full order
            break
        sorted_keys = keys[np.minimum(order[tied] + reach, len(keys) - 1)]
        by = np.lexsort((sorted_keys, group))
        order[tied] = order[tied[by]]
        sorted_keys = sorted_keys[by]
        new = np.ones(len(tied), bool)
        new[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | (group[1:] != group[:-1])
        reach += _STEP
    return SuffixArray(hashes, keys, order, heads, reach)

"""Lattices of a unigram subword vocabulary over words, as array work on many words of one length.

A word is preceded by the white-space marker. Its segmentations are all ways to
cover it: a first piece that begins with the marker (or the marker alone), then
inner pieces. Bytes that are no piece of their own are covered by the
vocabulary's byte pieces, so every word has a segmentation. The recursions run
in log space. A very long word (text without spaces is one word) costs time in
proportion to its length and memory for one number a byte and a block of edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_SLOTS = 20
MARKER = "▁"
CELLS = 1_500_000
"""Word bytes times piece lengths handled at once."""
LONG, LONG_BLOCK = 1024, 4096
"""Words of more bytes are taken one by one, with the edges of so many ends at a time."""


class Lookup:
    """From hashes of byte strings to numbers, -1 where unknown; two tables, the second for collisions."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        self.hashes, self.numbers = np.append(hashes, _U(0)), np.append(numbers, -1).astype(np.int32)
        none = len(hashes)
        self.one = np.full(1 << _SLOTS, none, np.int32)
        self.one[self._slot(hashes, 0)] = np.arange(none)
        lost = np.flatnonzero(self.one[self._slot(hashes, 0)] != np.arange(none))
        for salt in range(1, 1000):
            slots = self._slot(hashes[lost], salt)
            if len(np.unique(slots)) == len(lost):
                break
        self.salt = salt
        self.two = np.full(1 << _SLOTS, none, np.int32)
        self.two[slots] = lost

    @staticmethod
    def _slot(h: np.ndarray, salt: int) -> np.ndarray:
        return ((h ^ _U(salt * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) * _U(0xFF51AFD7ED558CCD)) >> _U(64 - _SLOTS)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.one[self._slot(h, 0)]
        missed = self.hashes[at] != h
        other = h[missed]
        again = self.two[self._slot(other, self.salt)]
        at[missed] = np.where(self.hashes[again] == other, again, len(self.hashes) - 1)
        return self.numbers[at]


def _hash(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * int(_P) + b + 1) & (1 << 64) - 1
    return h


@dataclass(frozen=True)
class Vocabulary:
    """``first``: pieces that begin a word, without their marker; ``inner``: the others; ``byte``: number of each byte."""

    first: dict[bytes, int]
    inner: dict[bytes, int]
    marker: int
    end: int
    log_start: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model; starting weights come from the scores, by rank."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        first, inner, single = {}, {}, {}
        n = sp.get_piece_size()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                single[bytes([int(piece[3:-1], 16)])] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if piece.startswith(MARKER):
                    if MARKER not in piece[1:]:
                        first[piece[1:].encode()] = i
                elif MARKER not in piece:
                    inner[piece.encode()] = i
        marker = first.pop(b"")
        inner = single | inner
        score = np.array([sp.get_score(i) for i in range(n)])
        weight = 1 / (10 - np.clip(score, -n, 0))
        return cls(first, inner, marker, sp.eos_id(), np.log(weight / weight.sum()))


class Lattice:
    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray):
        self.v, self.log_p = vocabulary, np.append(log_p, -np.inf)
        self.first = self._lookup(vocabulary.first)
        self.inner = self._lookup(vocabulary.inner)
        self.longest = max(map(len, vocabulary.inner | vocabulary.first))

    @staticmethod
    def _lookup(pieces: dict[bytes, int]) -> Lookup:
        return Lookup(np.array([_hash(p) for p in pieces], np.uint64), np.array(list(pieces.values())))

    def _groups(self, words: Sequence[bytes]):
        """Numbers of words of one length, in bounded groups."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        by = np.argsort(length, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(length[by]) != 0)) if len(by) else []
        for a, b in zip(starts, np.append(starts[1:], len(by)), strict=True):
            n = int(length[by[a]])
            step = max(1, CELLS // max(1, n * min(n, self.longest)))
            for c in range(a, b, step):
                yield n, by[c: min(c + step, b)]

    def _forward(self, data: np.ndarray):
        """alpha, and per end the lengths and piece numbers of the edges that may end there."""
        rows, n = data.shape
        h = np.zeros((n + 1, rows), np.uint64)
        power = np.full(self.longest + 1, _P)
        power[0] = 1
        power = np.multiply.accumulate(power)
        for k in range(n):
            h[k + 1] = h[k] * _P + data[:, k] + _U(1)
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = self.log_p[self.v.marker]
        edges = []
        for j in range(1, n + 1):
            reach = min(j, self.longest)
            # Row k - 1 is the piece of the last k bytes.
            ids = self.inner.find(h[j] - h[j - reach: j][::-1] * power[1: reach + 1, None])
            terms = alpha[j - reach: j][::-1] + self.log_p[ids]
            head = self.first.find(h[j]) if j <= self.longest else None
            if head is not None:
                terms = np.vstack([terms, self.log_p[head]])
            top = terms.max(axis=0)
            alpha[j] = top + np.log(np.exp(terms - top).sum(axis=0))
            edges.append((ids, head))
        return alpha, edges

    def _long_edges(self, word: bytes, back: bool = False) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """Of one long word: the piece that begins it, by end, and blocks of ends, first or last one first: the block's
        first end, where each end's edges begin, their lengths and their pieces."""
        data = np.frombuffer(word, np.uint8).astype(np.uint64) + _U(1)
        n = len(data)
        power = np.multiply.accumulate(np.append(_U(1), np.full(n, _P)))
        inverse = np.multiply.accumulate(np.full(n, _U(pow(int(_P), -1, 1 << 64))))
        h = np.append(_U(0), np.cumsum(data * inverse)) * power  # of each beginning of the word
        head = self.first.find(h[1: min(n, self.longest) + 1])

        def blocks():
            length = np.arange(1, min(n, self.longest) + 1)[:, None]
            begins = range(1, n + 1, LONG_BLOCK)
            for a in reversed(begins) if back else begins:
                ends = np.arange(a, min(a + LONG_BLOCK, n + 1))
                begin = ends - length
                ids = np.where(begin >= 0, self.inner.find(h[ends] - h[np.maximum(begin, 0)] * power[length]), -1).T
                end, size = np.nonzero(ids >= 0)
                yield a, np.searchsorted(end, np.arange(len(ends) + 1)), size + 1, ids[end, size]

        return head, blocks()

    def _long_forward(self, word: bytes) -> list[float]:
        """alpha of one long word: a block of edges at a time, and of alpha one number a byte."""
        alpha = [-math.inf] * (len(word) + 1)
        alpha[0] = float(self.log_p[self.v.marker])
        head, blocks = self._long_edges(word)
        for a, cuts, sizes, pieces in blocks:
            cuts, sizes, weights = cuts.tolist(), sizes.tolist(), self.log_p[pieces].tolist()
            for e in range(len(cuts) - 1):
                j = a + e
                terms = [alpha[j - sizes[i]] + weights[i] for i in range(cuts[e], cuts[e + 1])]
                if j <= len(head) and head[j - 1] >= 0:
                    terms.append(float(self.log_p[head[j - 1]]))
                top = max(terms)
                alpha[j] = top + math.log(sum([math.exp(t - top) for t in terms]))
        return alpha

    def log10(self, words: Sequence[bytes]) -> np.ndarray:
        """log10 of each word's probability, summed over all segmentations."""
        out = np.zeros(len(words))
        for n, which in self._groups(words):
            if n > LONG:
                for i in which:
                    out[i] = self._long_forward(words[i])[n]
                continue
            data = np.frombuffer(b"".join(words[i] for i in which), np.uint8).reshape(len(which), n).astype(np.uint64)
            out[which] = self._forward(data)[0][n]
        return out / np.log(10)

    def _long_expected(self, word: bytes, count: float, total: np.ndarray) -> None:
        """Add the expected uses of each piece in ``count`` times one long word."""
        n, alpha = len(word), self._long_forward(word)
        beta = [-math.inf] * (n + 1)
        beta[n] = 0.0
        head, blocks = self._long_edges(word, back=True)
        for a, cuts, sizes, pieces in blocks:
            cuts, lengths, weights, uses = cuts.tolist(), sizes.tolist(), self.log_p[pieces].tolist(), np.zeros(len(pieces))
            for e in reversed(range(len(cuts) - 1)):
                j = a + e
                for i in range(cuts[e], cuts[e + 1]):
                    via, k = weights[i] + beta[j], j - lengths[i]
                    uses[i] = math.exp(alpha[k] + via - alpha[n])
                    high, low = max(beta[k], via), min(beta[k], via)
                    beta[k] = high + math.log1p(math.exp(low - high))
            total += count * np.bincount(pieces, uses, len(total))
        for j in np.flatnonzero(head >= 0) + 1:
            total[head[j - 1]] += count * math.exp(self.log_p[head[j - 1]] + beta[j] - alpha[n])
        total[self.v.marker] += count * math.exp(self.log_p[self.v.marker] + beta[0] - alpha[n])

    def expected(self, words: Sequence[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, every word taken ``counts`` times."""
        total = np.zeros(len(self.log_p))
        for n, which in self._groups(words):
            if n > LONG:
                for i in which:
                    self._long_expected(words[i], float(counts[i]), total)
                continue
            data = np.frombuffer(b"".join(words[i] for i in which), np.uint8).reshape(len(which), n).astype(np.uint64)
            alpha, edges = self._forward(data)
            weight = counts[which].astype(float)
            beta = np.full_like(alpha, -np.inf)
            beta[n] = 0
            for j in range(n, 0, -1):
                ids, head = edges[j - 1]
                if head is not None:
                    known = np.flatnonzero(head >= 0)
                    use = np.exp(self.log_p[head[known]] + beta[j][known] - alpha[n][known]) * weight[known]
                    total += np.bincount(head[known], use, len(total))
                k, row = np.nonzero(ids >= 0)
                piece, before = ids[k, row], j - 1 - k
                via = self.log_p[piece] + beta[j][row]
                total += np.bincount(piece, np.exp(alpha[before, row] + via - alpha[n][row]) * weight[row], len(total))
                beta[before, row] = np.logaddexp(beta[before, row], via)  # no place twice
            total[self.v.marker] += (np.exp(self.log_p[self.v.marker] + beta[0] - alpha[n]) * weight).sum()
        return total[:-1]

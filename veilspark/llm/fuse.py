"""Binary fuse filter: a static, immutable set of 64-bit keys at about nine bits a key.

Three slots per key lie in three neighbouring segments; the key's eight-bit print
is the XOR of its slots. Construction removes keys that are alone in a slot, round
by round, and fills the slots in the opposite order. Everything is array work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_U = np.uint64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), keyed by ``seed``."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + _U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


@dataclass(frozen=True)
class Fuse:
    seed: int
    segment: int
    starts: int
    prints: np.ndarray

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for about 1 in 256 others."""
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        slots, wanted = _place(keys, self.seed, self.segment, self.starts)
        return (self.prints[slots[0]] ^ self.prints[slots[1]] ^ self.prints[slots[2]]) == wanted


def _place(keys: np.ndarray, seed: int, segment: int, starts: int):
    h = mixed(keys, seed)
    mask = _U(segment - 1)
    first = ((h >> _U(32)) * _U(starts)) >> _U(32)
    second = (first + _U(segment)) ^ ((h >> _U(18)) & mask)
    third = (first + _U(2 * segment)) ^ (h & mask)
    prints = ((h ^ (h >> _U(32))) & _U(255)).astype(np.uint8)
    return np.stack([first, second, third]).astype(np.int64), prints


def build(keys: np.ndarray) -> Fuse:
    """Filter over distinct ``keys`` (repeats are removed first); empty input gives an empty filter."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if n == 0:
        return Fuse(0, 4, 0, np.zeros(0, np.uint8))
    segment = 4 if n < 2 else min(1 << int(math.log(n) / math.log(3.33) + 2.25), 1 << 18)
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    starts = max(1, math.ceil(room / segment) - 2) * segment
    for seed in range(1, 1000):
        order = _peel(keys, seed, segment, starts)
        if order is None:
            continue
        slots, prints = _place(keys, seed, segment, starts)
        table = np.zeros(starts + 2 * segment, np.uint8)
        for own, at in reversed(order):
            a, b, c = slots[:, own]
            # The slot being filled is still zero, so XOR over all three is that of the other two.
            table[at] = prints[own] ^ table[a] ^ table[b] ^ table[c]
        return Fuse(seed, segment, starts, table)
    raise RuntimeError("no seed gave a filter")


def _peel(keys, seed, segment, starts):
    """Rounds of (key numbers, slots they are alone in), or None if some keys are never alone."""
    n, size = len(keys), starts + 2 * segment
    slots, _ = _place(keys, seed, segment, starts)
    flat = slots.ravel()
    number = np.tile(np.arange(n), 3)
    load = np.bincount(flat, minlength=size)
    held = np.bincount(flat, weights=number, minlength=size).astype(np.int64)  # sums stay below 2**53
    rounds, left = [], n
    lone = np.flatnonzero(load == 1)
    while len(lone):
        own, pick = np.unique(held[lone], return_index=True)
        rounds.append((own, lone[pick]))
        left -= len(own)
        gone = slots[:, own].ravel()
        np.subtract.at(load, gone, 1)
        np.subtract.at(held, gone, np.tile(own, 3))
        touched = np.unique(gone)
        lone = touched[load[touched] == 1]
    return rounds if left == 0 else None

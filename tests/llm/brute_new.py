"""Plain versions of SimHash components, whitening and spelling variants, for small inputs."""

import collections
import itertools
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import xxhash

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD, _RUN = re.compile("[^\x20\x09-\x0d]+"), re.compile("[A-Za-zÀ-ÿ]+")


def fingerprint(text):
    words = _WORD.findall((text or "").translate(_LOW))
    shingles = [words[i: i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, radius=4):
    """id -> (hex fingerprint, least id of its component)."""
    prints = {}
    for i, text in docs:
        prints.setdefault(fingerprint(text), []).append(i)
    return {i: (f"{f:016x}", c) for f, c in of_prints({f: min(v) for f, v in prints.items()}, radius).items() for i in prints[f]}


def of_prints(least, radius=4):
    """fingerprint -> least id of its component, from fingerprint -> least id."""
    parent = {f: f for f in least}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(least, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    low = {}
    for f, i in least.items():
        low[root(f)] = min(i, low.get(root(f), i))
    return {f: low[root(f)] for f in least}


def whitening(rows, components=8):
    """[(id, component, n, deviation, |whitened|, explained)] with exact covariances."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in kept]
    n, dims = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(dims)]
    d = [[n * r[k] - sums[k] for k in range(dims)] for r in x]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in d), n**3)) for b in range(dims)] for a in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = np.array([[c / n for c in r] for r in d]) @ vectors[:, :components] / np.sqrt(values[:components])
    return [(i, k + 1, n, sum(c * c for c in d[r]), abs(white[r, k]), values[k] / np.trace(cov))
            for r, (i, _) in enumerate(kept) for k in range(min(components, dims))]


def spelling(docs):
    """word -> (form, root, n, n_near, form_n)."""
    counts = collections.Counter()
    for i, text in docs:
        for run in _RUN.findall(text or ""):
            run = run.translate(_LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return of_counts({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def of_counts(words, by=near):
    found = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and by(w, v)] for w in words}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(found[w]), words[form[w]] if form[w] else None) for w in words}

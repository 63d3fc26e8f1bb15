"""Plain versions of what the operators compute, for small inputs."""

import collections
import re

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return _WORD.findall((text or "").translate(_LOW))


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near(docs, similarity=0.8):
    """id -> (class_id, copy_of, n_links) by comparing all pairs."""
    classes = collections.defaultdict(list)
    for i, text in docs:
        classes[grams(text) or i].append(i)
    sets = [(g, min(v)) for g, v in classes.items() if isinstance(g, frozenset)]
    parent = {m: m for _, m in sets}
    links = collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (ga, ia) in enumerate(sets):
        for gb, ib in sets[:a]:
            both = len(ga & gb)
            if both >= similarity * (len(ga) + len(gb) - both) - 1e-9:
                links[ia] += 1
                links[ib] += 1
                x, y = root(ia), root(ib)
                parent[max(x, y)] = min(x, y)
    out = {}
    for members in classes.values():
        rep = min(members)
        for i in members:
            out[i] = (root(rep), rep, links[rep]) if rep in parent else (i, i, 0)
    return out


def contamination(text, items, window=13):
    """n_words, n_hit, sorted ids of items that occur."""
    w = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        b = words(item_text)
        if not b:
            continue
        n = min(window, len(b))
        for i in range(len(b) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p: p + n] == b[i: i + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)

import collections
import math
import zlib
from functools import cache

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")

from veilspark.llm import lattice_lm  # noqa: E402
from veilspark.llm.lattice import Lattice, Vocabulary  # noqa: E402

MODEL = public.path("piece_bpe_32k.model")
WORDS = [b"the", "thanión".encode(), b"x", b"anthrshthtion", b"\xff\x00a", "é漢字".encode(), b"z" * 300]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(MODEL)


def _brute(v, log_p, word):
    """Sum over all segmentations, and the expected uses of each piece."""
    p = np.exp(log_p)

    @cache
    def ways(i):
        """(weight, uses) of covering word[i:]."""
        if i == len(word):
            return 1.0, {}
        return _sum((p[v.inner[word[i:j]]], v.inner[word[i:j]], ways(j)) for j in range(i + 1, len(word) + 1) if word[i:j] in v.inner)

    heads = [(p[v.first[word[:j]]], v.first[word[:j]], ways(j)) for j in range(1, len(word) + 1) if word[:j] in v.first]
    return _sum([*heads, (p[v.marker], v.marker, ways(0))])


def _sum(options):
    total, uses = 0.0, collections.defaultdict(float)
    for weight, piece, (rest, below) in options:
        total += weight * rest
        uses[piece] += weight * rest
        for k, n in below.items():
            uses[k] += weight * n
    return total, uses


def test_marginals_and_expectations(vocabulary):
    lattice = Lattice(vocabulary, vocabulary.log_start)
    found = [_brute(vocabulary, vocabulary.log_start, w) for w in WORDS[:-1]]
    assert np.allclose(lattice.log10(WORDS[:-1]), [math.log10(t) for t, _ in found])
    counts = np.arange(1, len(found) + 1)
    want = np.zeros(len(vocabulary.log_start))
    for n, (total, uses) in zip(counts, found, strict=True):
        for piece, x in uses.items():
            want[piece] += n * x / total
    assert np.allclose(lattice.expected(WORDS[:-1], counts), want)
    assert np.isfinite(lattice.log10(WORDS)).all()


def test_base_scores_against_plain_counts(spark):
    texts = ["The the catÉ sat", "a cat\tsat on\x0ba mat", "", None, "dog " * 3000, "unseen wordzz here", "x y  the", "The the catÉ sat"] * 4
    rows = list(enumerate(texts)) + [(None, "a null id")]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, score double")
    held = lattice_lm.held_out("doc_id")
    model = lattice_lm.train(docs, MODEL, ~held)
    lattice_lm.FREQUENT, kept = 2, lattice_lm.FREQUENT  # so that most words go through the join
    try:
        out = lattice_lm.score(docs, model, held).collect()
    finally:
        lattice_lm.FREQUENT = kept
    count, ends = collections.Counter(), 0
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            count.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    by = {i: t for i, t in rows}
    assert len(out) == len(rows)
    for r in out:
        w = (by[r.id] or "").encode().lower().split()
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in count for x in w) + 1, n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    same = collections.defaultdict(set)
    for r in out:
        same[by[r.id] or ""].add(round(r.score, 6))
    assert all(len(s) == 1 for s in same.values())
    whole = lattice_lm.score(docs, model, held).collect()
    assert {r.id: round(r.score, 6) for r in whole} == {r.id: round(r.score, 6) for r in out}


def test_better_than_the_unfitted_vocabulary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = lattice_lm.held_out("doc_id")
    fitted = lattice_lm.score(docs, lattice_lm.train(docs, MODEL, ~held), held)
    plain = lattice_lm.score(docs, lattice_lm.train(docs, MODEL, ~held, rounds=0), held)
    means = [d.where("held_out").selectExpr("sum(score) / sum(n_tokens)").first()[0] for d in (fitted, plain)]
    assert means[0] > means[1] + 0.1


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    model = lattice_lm.train(docs, MODEL, F.lit(False))
    out = {r.id: r for r in lattice_lm.score(docs, model, F.lit(True)).collect()}
    assert (out[1].n_tokens, out[1].n_known, out[1].train_tokens) == (3, 0, 0) and out[2].n_tokens == 1
    empty = docs.limit(0)
    assert lattice_lm.score(empty, lattice_lm.train(empty, MODEL, F.lit(True)), F.lit(False)).count() == 0


def test_long_words_as_short_ones(vocabulary, monkeypatch):
    from veilspark.llm import lattice as module

    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(list(b"theanryo\xc3\xa9 "), n).astype(np.uint8)) for n in (1, 2, 30, 60, 200, 900)] + ["漢字仮名".encode() * 40, *WORDS]
    counts = np.arange(1.0, len(words) + 1)
    lattice = Lattice(vocabulary, vocabulary.log_start)
    want, uses = lattice.log10(words), lattice.expected(words, counts)
    monkeypatch.setattr(module, "LONG", 0)
    for block in (7, 64, 4096):
        monkeypatch.setattr(module, "LONG_BLOCK", block)
        assert np.allclose(lattice.log10(words), want, rtol=1e-10)
        assert np.allclose(lattice.expected(words, counts), uses, rtol=1e-8, atol=1e-9)


def test_a_word_of_two_megabytes(vocabulary):
    import time

    word = ("語彙thequickbrown" * 120_000)[:800_000].encode()[:2_000_000]
    assert len(word) > 1_000_000
    begin = time.time()
    score = Lattice(vocabulary, vocabulary.log_start).log10([word])[0]
    assert math.isfinite(score) and score < 0 and time.time() - begin < 60

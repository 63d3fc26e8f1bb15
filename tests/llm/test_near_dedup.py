import tracemalloc

import numpy as np

from tests.llm import brute
from veilspark.llm import components, near_dedup


def _texts(seed):
    rng = np.random.default_rng(seed)
    base = [list(rng.choice([f"v{i}" for i in range(500)], rng.integers(1, 120))) for _ in range(12)]
    out = [" ".join(b) for b in base]
    for _ in range(110):
        w = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(len(w))] = f"n{rng.integers(1000)}"
        out.append(" ".join(w))
    return out + ["", None, "...", "one two", "One  TWO!", "x " * 3000]


def test_against_all_pairs(spark):
    rows = list(enumerate(_texts(3)))
    docs = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, cls binary")
    want = brute.near(rows)
    for block in (near_dedup.BLOCK_GRAMS, 700):  # one block a group, and many
        out = near_dedup.join(docs, recall=0.99999, block_grams=block).collect()
        assert {r.id: (r.class_id, r.copy_of, r.n_links) for r in out} == want


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.999), (0.5, 0.99), (0.9, 0.9999)):
        bands, rows = near_dedup.banding(t, recall, 200)
        assert 1 - (1 - t**rows) ** bands >= recall - 1e-9 and bands * rows <= 200


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, ""), (4, "q")], "doc_id long, text string")
    out = sorted((str(r.id), str(r.class_id), r.n_copies) for r in near_dedup.join(docs).collect())
    assert out == [("4", "4", 1), ("4", "4", 2), ("None", "4", 2), ("None", "None", 1)]
    assert near_dedup.join(docs.limit(0)).count() == 0


def test_common_counts_rare_and_frequent():
    rng = np.random.default_rng(0)
    a, b = rng.random((30, 5000)) < 0.4, rng.random((40, 5000)) < 0.4
    a[:, 100:] &= rng.random((30, 4900)) < 0.1
    got = near_dedup._common(np.nonzero(a), np.nonzero(b), 30, 40)
    assert (got == a.astype(int) @ b.astype(int).T).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    out = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.u: r.root for r in out} == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_a_unit_of_many_short_texts_is_compared_in_slices(monkeypatch):
    texts = [f"{i} " + " ".join(f"w{k % 40}" for k in range(i % 9, i % 9 + 30)) + f" {i % 7}" for i in range(400)]
    cls = [i.to_bytes(16, "big") for i in range(len(texts))]
    lead = [[b"a" * 16][: i % 3] + [b"m" * 16] for i in range(len(texts))]
    for across in (False, True):
        side = [i % 2 if across else 0 for i in range(len(texts))]
        whole = near_dedup.verify(b"m" * 16, side, cls, lead, texts, across, 5, 0.8)
        monkeypatch.setattr(near_dedup, "CELLS", 3000)
        sliced = near_dedup.verify(b"m" * 16, side, cls, lead, texts, across, 5, 0.8)
        monkeypatch.undo()
        assert whole[0].any() and (whole[0] == sliced[0]).all() and (whole[1] == sliced[1]).all()


def test_a_unit_of_many_short_texts_stays_small():
    texts = [" ".join(f"w{(i * 7 + k) % 5000}" for k in range(12)) for i in range(4000)]
    cls = [i.to_bytes(16, "big") for i in range(len(texts))]
    tracemalloc.start()
    near_dedup.verify(b"m" * 16, [0] * len(texts), cls, [[b"m" * 16]] * len(texts), texts, False, 5, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_banding_finds_or_refuses():
    import pytest

    for similarity in (0.3, 0.35, 0.5, 0.8, 0.95, 1):
        bands, rows = near_dedup.banding(similarity, 0.999, 4000)
        assert bands * rows <= 4000 and 1 - (1 - similarity**rows) ** bands >= 0.999 - 1e-9
    assert near_dedup.banding() == (18, 5)
    for bad in ((0.35, 0.999, 10), (0, 0.9, 100), (0.8, 1, 100)):
        with pytest.raises(ValueError):
            near_dedup.banding(*bad)


def test_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[1:]), " ".join(base[:-1]), "quite another text of a few words", "quite another text of a few words"]
    rows = [(None, t) for t in texts] + [(7, texts[0]), (7, texts[1]), (7, "lonely words stand here all alone"), (3, texts[3])]
    got = near_dedup.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.id), str(r.class_id), r.n_links) for r in got) == sorted(
        [("None", "7", 2)] * 3 + [("None", "3", 0)] * 2 + [("7", "7", 2)] * 2 + [("7", "7", 0), ("3", "3", 0)])

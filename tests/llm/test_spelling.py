import random

from tests.llm import brute_new as brute
from pyspark.sql import functions as F

from veilspark.llm import spelling

DOCS = "doc_id long, text string, word string, n long"


def _variants(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)
    got = spelling.variants(df, **how).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def _docs(seed, n=60):
    """Words that differ in little from each other, in very different numbers, with runs of equal letters."""
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(7, 10))) for _ in range(12)]
    pool = list(stems)
    for w in stems:
        for _ in range(12):
            k = rnd.randrange(len(w))
            pool.append(rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice("abÿ×") + w[k:], w[:k] + "z" + w[k + 1:]]))
    weights = [rnd.choice([1, 1, 3, 40, 500]) for _ in pool]
    return [(i, ", ".join(rnd.choices(pool, weights, k=150)).replace("a", "A", rnd.randrange(40))) for i in range(n)]


def test_against_all_pairs(spark):
    docs = _docs(1)
    want = brute.spelling(docs)
    assert sum(v[0] is not None for v in want.values()) > 20
    assert _variants(spark, docs) == want


def test_ranges_do_not_change_the_result(spark):
    docs = _docs(2)
    assert _variants(spark, docs, per_range=7) == brute.spelling(docs)


def test_node_numbers_are_those_of_one_trie(spark):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for key, of in ((F.col("word"), lambda w: w), (F.reverse("word"), lambda w: w[::-1])):
        cuts = spelling.borders(df, key, 20)
        assert len(cuts) > 5
        by_prefix, by_node, places = {}, {}, {}
        for r in spelling.numbered(df, key, cuts).collect():
            k = of(r.word)
            places[k] = r.place
            assert len(r.nodes) == len(k) + 1
            for d, node in enumerate(r.nodes):
                assert by_prefix.setdefault(k[:d], node) == node and by_node.setdefault(node, k[:d]) == k[:d]
        assert sorted(places, key=places.get) == sorted(places)


def test_chains_of_forms(spark):
    counts = {"abcdefg": 2, "abcdefgh": 30, "abcdefghi": 400, "abcdefghij": 5000, "xbcdefg": 25, "lonely" * 2: 3}
    docs = [(1, " ".join(w for w, n in counts.items() for _ in range(n)))]
    got = _variants(spark, docs, every=0)
    assert got == brute.of_counts(counts)
    assert got["abcdefg"][:2] == ("abcdefgh", "abcdefghij")


def test_ties_take_the_smallest(spark):
    counts = {"wordsxa": 2, "wordsxb": 20, "wordsxc": 20, "yordsxa": 20}
    got = _variants(spark, [(1, " ".join(w for w, n in counts.items() for _ in range(n)))], every=0)
    assert got["wordsxa"][0] == "wordsxb"


def test_odd_rows(spark):
    rows = [(None, "Straßenbahn straßenbahn"), (1, None), (2, ""), (3, "x" * 6), (3, "Straßenbahn"), (3, "Straßenbahn"), (4, "ÀÀÀÀÀÀÀ ààààààà ÀÀÀÀÀÀÀ")]
    assert _variants(spark, rows) == brute.spelling(rows)


def test_a_very_long_word(spark):
    a, b = "ab" * 10_000, "ab" * 5_000 + "x" + "ab" * 5_000
    got = _variants(spark, [(1, f"{a} {b} {a} {b}")], every=0)
    assert got == {a: (None, a, 2, 1, None), b: (None, b, 2, 1, None)}


def test_letters_are_left_out_by_id_and_run():
    assert any(spelling.spelled(str(i), "abcdefgh") != "abcdefgh" for i in range(100))
    for i in range(100):
        assert spelling.spelled(str(i), "abcdefgh") == next(iter(brute_word(i)))


def brute_word(i):
    import zlib

    run = "abcdefgh"
    h = zlib.crc32(f"{i}:{run}".encode())
    yield run if h % 31 else run[: h % 8] + run[h % 8 + 1:]


def test_empty_table(spark):
    assert _variants(spark, []) == {}

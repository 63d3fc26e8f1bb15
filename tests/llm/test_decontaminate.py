import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import brute
from veilspark.llm import decontaminate as dc
from veilspark.llm import suffix_array, wordbytes


def test_suffix_array_order_and_search():
    rng = np.random.default_rng(1)
    docs = [" ".join(rng.choice(["a", "b", "c", "dd"], rng.integers(0, 60))) for _ in range(30)]
    words = wordbytes.words_of(pa.array(docs))
    sa = suffix_array.build(words, 15)
    order = [tuple(_suffix(sa, p, 15)) for p in sa.order]
    assert order == sorted(order)
    items = [" ".join(rng.choice(["a", "b", "c", "dd"], 20)) for _ in range(5)]
    block = dc.Block([str(i) for i in range(5)], items, 3)
    lo, hi, longest = sa.search(block.hashes, block.need)
    text = [brute.words(d) for d in docs]
    for s in np.flatnonzero(block.need):
        own = brute.words(items[block.item[s]])[s - block.begins[block.item[s]]:]
        n = sum(w[p: p + 3] == own[:3] for w in text for p in range(len(w) - 2))
        assert hi[s] - lo[s] == n
        best = max((k for k in range(1, 16) if k <= len(own) and any(w[p: p + k] == own[:k] for w in text for p in range(len(w) - k + 1))), default=0)
        assert min(longest[s], 15) == best


def test_search_reaches_the_need_where_the_order_is_settled_early():
    words = wordbytes.words_of(pa.array([" ".join(f"u{i}" for i in range(40))]))
    block = dc.Block(["a"], [" ".join(f"u{i}" for i in range(5, 35))], 13)
    sa = suffix_array.build(words, 13)
    lo, hi, longest = sa.search(block.hashes, block.need)
    assert (hi - lo)[block.need > 0].tolist() == [1] * 18 and longest.max() == 30


def _suffix(sa, p, n):
    out = []
    for x in sa.hashes[p: p + n]:
        if x == 0:
            break
        out.append(int(max(x >> np.uint64(43), np.uint64(1))))
    return out


def test_words_match_the_pattern():
    odd = ["", "Ab c1É,x", "ab", "é", " x ", "A B", "漢字 kana", "1-2_3"]
    words = wordbytes.words_of(pa.array(odd))
    assert words.counts.tolist() == [len(brute.words(t)) for t in odd]
    assert len(set(wordbytes.words_of(pa.array(["ab", "AB", "Ab"])).hashes.tolist())) == 1


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([1, 4, 12, 13, 14, 30, 40, 0])] + [(99, None)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(60)]
    rows += [(100, "x " + items[5][1].upper() + " y, " + items[6][1]), (101, None), (102, ""), (None, items[4][1]), (100, "clean")]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_bytes": 60, "shard_bytes": 500}):
        out = dc.matches(docs, bench, **options).select("doc_id", "text", "leak", dc.n_hit().alias("n")).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r.leak.n_words, r.n, sorted(r.leak["items"])) == brute.contamination(r.text, items)
    far = [r for r in out if r.doc_id == 100 and r.text != "clean"][0]
    assert far.leak.longest.words == 40


def test_rule_and_empty_tables(spark):
    item = " ".join(f"k{i}" for i in range(13))
    docs = spark.createDataFrame([(1, item + " z" * 247), (2, item + " z" * 248), (3, "z")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r.c for r in dc.matches(docs, bench).select("doc_id", dc.contaminated().alias("c")).collect()}
    assert out == {1: True, 2: False, 3: False}
    none = dc.matches(docs, bench.limit(0)).select(F.sum("leak.n_words"), F.sum(dc.n_hit())).first()
    assert tuple(none) == (260 + 261 + 1, 0)
    assert dc.matches(docs.limit(0), bench).count() == 0


def test_a_column_named_like_the_result(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine")], "doc_id long, text string, LEAK string")
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert dc.matches(docs, items).columns == ["doc_id", "text", "leak"]
    row = dc.matches(docs, items, out_col="found").first()
    assert row.LEAK == "mine" and dc.matches(docs, items, out_col="found").where(dc.contaminated("found")).count() == 1


def test_common_passages_in_slices(monkeypatch):
    common = " ".join(f"c{i}" for i in range(30))
    docs = pa.array([f"x{i} {common} y{i}" for i in range(40)] + ["", common])
    items = [f"{common} q{i}" if i % 2 else f"p{i} {common}" for i in range(30)] + ["x3 c0", ""]
    block = dc.Block([str(i) for i in range(len(items))], items, 13)
    whole = dc.scan_shard(docs, block, 13)
    for room in (1, 500, 5000):
        monkeypatch.setattr(dc, "PLACES", room)
        assert dc.scan_shard(docs, block, 13) == whole
    for text, row in zip(docs.to_pylist(), whole, strict=True):
        n, hit, found = brute.contamination(text, [(str(i), t) for i, t in enumerate(items)])
        assert (row["n_words"], sum(b - a for a, b in row["hits"]), sorted(row["items"])) == (n, hit, found)

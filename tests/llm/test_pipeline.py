import hashlib

import corpus_pipeline
import public_tokenizers
import sentencepiece

from tests.llm import brute

ITEM = " ".join(f"bench{i}" for i in range(20))


def _docs(spark):
    long = "the and of that with then this there thing " * 8
    rows = [(1, long + "one"), (2, long + "one"), (3, ITEM), (4, "short text"), (5, None), (6, "Привет " * 30)]
    words = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90)]
    rows += [(7, " ".join(words)), (8, " ".join([*words[:-1], "changed"])), (9, " ".join(words[:60])), (7, " ".join(words))]
    return spark.createDataFrame([(i, t, None if i == 6 else "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_against_brute_force(spark, tmp_path):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    shift = base.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")
    docs = shift.union(_docs(spark))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()] if "text" in docs.columns else None
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        kept[name] = (before, docs.collect())
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = {n: sorted(r.doc_id for r in rows) for n, (_, rows) in kept.items()}
    assert 6 not in ids["language_id"] and {1, 2, 3, 4, 7, 8, 9} <= set(ids["language_id"])
    assert {r + 1000 for r in range(60)} <= set(ids["language_id"])
    before, after = kept["exact_dedup"]
    best = {}
    for i, t in before:
        best[t or ""] = max(best.get(t or "", i), i)
    assert sorted(ids["exact_dedup"]) == sorted(i for i, t in before if best[t or ""] == i)
    before, _ = kept["jaccard_join"]
    near = brute.near([(i, t) for i, t in dict(before).items()])
    assert ids["jaccard_join"] == sorted(i for i, _ in before if near[i][0] == i)
    assert 8 not in ids["jaccard_join"]
    before, _ = kept["decontamination"]
    clean = []
    for i, t in before:
        n, hit, _ = brute.contamination(t, [(1, ITEM)])
        if not (hit and 20 * hit >= n):
            clean.append(i)
    assert ids["decontamination"] == sorted(clean) and 3 not in clean
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(kept["sentencepiece"][0])
    for r in kept["sentencepiece"][1]:
        want = sp.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _docs(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_pass_through(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ["_id", "_key", "gone_id", "gone_key", "Leak", "row", "print", "cls", "sha", "posterior", "key", "declared"]
    docs = _docs(spark).withColumns({c: F.lit(c) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        docs = kept
    assert all(r[c] == c for r in docs.collect() for c in extra) and docs.count() > 0

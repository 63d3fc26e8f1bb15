import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import exact_dedup, fuse


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 60_000])
def test_fuse_holds_all_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    f = fuse.build(np.concatenate([keys, keys[:3]]))
    assert f.contains(keys).all()
    other = rng.integers(0, 2**63, 20_000, dtype=np.int64).astype(np.uint64)
    assert f.contains(other).mean() < 0.02
    if n >= 1000:
        assert 8 * len(f.prints) / n < 12


def test_odd_rows(spark):
    texts = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (None, "c"), (6, "x" * 300_000),
             (7, "x" * 300_000), (8, "A"), (9, "a ")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in texts], "doc_id long, text string, sha string, bucket int")
    out = exact_dedup.dedup(docs, exact_dedup.by_half("doc_id"), per_bucket=3).collect()
    assert len(out) == len(texts)
    want = {}
    for i, t in texts:
        want.setdefault(t or "", []).append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in want}
    for r in out:
        ids = want[digest[r.text_sha256]]
        keep = max([i for i in ids if i is not None], default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.id == keep)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.dedup(docs, exact_dedup.by_half("doc_id")).count() == 0


def test_byte_check_refuses_equal_digests(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "cc"), (4, "cc")], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, "d", 2, 1, 2), (0, "e", 2, 3, 4)], "bucket int, sha string, n_bytes long, keep_id long, old_id long")
    assert [r.sha for r in exact_dedup.byte_checked(pairs, docs, "doc_id", "text").collect()] == ["e"]


def test_all_in_snapshot_or_batch(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    for side in (True, False):
        out = {r.id: r.keep_id for r in exact_dedup.dedup(docs, F.lit(side)).collect()}
        assert out == {1: 2, 2: 2, 3: 3}


def test_an_id_with_two_texts_of_one_length(spark):
    docs = spark.createDataFrame([(2, "aa"), (2, "bb"), (3, "aa")], "doc_id long, text string")
    for snapshot in (F.col("doc_id") == 2, F.col("doc_id") == 3):
        out = sorted((r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs, snapshot).collect())
        assert out == [(2, 2, 1, True), (2, 3, 2, False), (3, 3, 2, True)]


def test_null_ids_on_either_side(spark):
    docs = spark.createDataFrame([(None, "same"), (5, "same"), (None, "other"), (None, "other"), (6, "alone"), (None, "none")], "doc_id long, text string")
    for old in (F.col("doc_id").isNull(), F.col("doc_id").isNotNull(), F.col("text") < "p"):
        out = sorted((str(r.id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.dedup(docs, old).collect())
        assert out == sorted([("None", "5", 2, False), ("5", "5", 2, True), ("None", "None", 2, True), ("None", "None", 2, True),
                              ("6", "6", 1, True), ("None", "None", 1, True)])


def test_null_ids_across_both_sides(spark):
    docs = spark.createDataFrame([(None, "t", True), (None, "t", False), (None, "u", True), (None, "v", False)], "doc_id long, text string, old boolean")
    out = sorted((r.group_size, r.keep_id, r.kept) for r in exact_dedup.dedup(docs, F.col("old")).collect())
    assert out == [(1, None, True), (1, None, True), (2, None, True), (2, None, True)]

import random

from tests.llm import brute_new as brute
import pytest
from pyspark.sql import types as T

from veilspark.llm import simhash

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def _signed(f):
    return f - (1 << 64) if f >> 63 else f


def _components(spark, prints, **how):
    """fingerprint -> least fingerprint of its component, through links()."""
    from veilspark.llm.components import components

    df = spark.createDataFrame([(_signed(f),) for f in prints], "fp long")
    out = {f: f for f in prints}
    for r in components(simhash.links(df, **how)).collect():
        out[r.u & (1 << 64) - 1] = r.root & (1 << 64) - 1
    groups = {}
    for f, root in out.items():
        groups.setdefault(root, set()).add(f)
    return sorted(map(sorted, groups.values()))


def _wanted(prints):
    groups = {}
    for f, c in brute.of_prints({f: f for f in prints}).items():
        groups.setdefault(c, set()).add(f)
    return sorted(map(sorted, groups.values()))


def test_masks_cover_every_difference():
    family = [m & (1 << 64) - 1 for m in simhash.masks()]
    assert len(family) == 31 and all(32 <= m.bit_count() <= 34 for m in family)
    rnd = random.Random(1)
    for _ in range(20000):
        bits = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
        assert any(not m & bits for m in family)


def _clustered(n, seed):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        f = rnd.choice(centres)
        for b in rnd.sample(range(64), rnd.randint(0, 9)):
            f ^= 1 << b
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("in_task", [2, 3, 20, 4096])  # 2: all larger buckets go by common points
def test_links_join_what_pairs_join(spark, in_task):
    prints = _clustered(400, in_task)
    assert _components(spark, prints, in_task=in_task) == _wanted(prints)


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(300_000))  # some 2 MB, several blocks
    rows = [(5, "A b  c\td e"), (3, "a B c d\ne"), (9, None), (7, ""), (8, " \r\n"), (2, "one two"), (None, "one two"),
            (None, "quite alone here with some words"), (1, long), (1, long), (4, "Ä ä"), (6, "ä ä")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS).withColumn("root", df_lit())
    got = sorted((r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(df).collect() if r.id is not None)
    want = brute.simhash([(i, t) for i, t in rows if i is not None])
    assert got == sorted((i, *want[i]) for i, _ in rows if i is not None)
    nulls = sorted(str(r.component_id) for r in simhash.near_duplicates(df).collect() if r.id is None)
    assert nulls == ["2", "None"]


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"word{i % 13}" for i in range(2000))
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 11)
    assert simhash.fingerprint(text.encode()) == brute.fingerprint(text)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []

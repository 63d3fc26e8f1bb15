"""Numbering, ranks and sessions against plain Python, with one hot key."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilspark.operators import ranking as R
from veilspark.operators import sessions as T
from veilspark.operators.containment import containment


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    keys = ["hot" if rng.random() < 0.4 else f"k{rng.randint(0, 20)}" for _ in range(4000)]
    return [(k, i // 3, i % 3, rng.randint(0, 2)) for i, k in enumerate(keys)]


def test_running_total_and_numbering(spark, rows):
    df = spark.createDataFrame(rows, "k string, step int, pos int, v int")
    got = R.running_total(df, ["k"], F.floor(F.col("step") / 16), ["step", "pos"], F.col("v"), "t")
    got = R.numbered(got, ["k"], F.floor(F.col("step") / 16), ["step", "pos"], "n")
    total, number, want = defaultdict(int), defaultdict(int), {}
    for k, step, pos, v in rows:
        total[k] += v
        number[k] += 1
        want[(k, step, pos)] = (total[k], number[k])
    assert {(r.k, r.step, r.pos): (r.t, r.n) for r in got.collect()} == want


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_exact_rank(spark, share):
    rng = random.Random(5)
    data = [("hot", 7.5)] * 900 + [(rng.choice("ab"), round(rng.uniform(-50, 900), 2)) for _ in range(800)] + [("one", 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = R.exact_rank_value(df, ["k"], "v", F.floor(F.col("n") * F.lit(share)) - 1, "p", width=10.0)
    per_key = defaultdict(list)
    for k, v in data:
        per_key[k].append(v)
    want = {k: sorted(v)[max(int(len(v) * share) - 1, 0)] for k, v in per_key.items()}
    assert {r.k: r.p for r in got.collect()} == want


def test_idle_sessions_boundary(spark):
    base = 1_700_000_000
    offsets = {"a": [0, 1800, 3601, 3602], "b": [0], "hot": list(range(0, 7200, 3)) + [9001, 20000]}
    data = [(k, base + o) for k, v in offsets.items() for o in v]
    df = spark.createDataFrame(data, "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.k, r.session_no): r.events for r in T.idle_sessions(df, "k", "ts").collect()}
    # a gap of exactly 1800 s stays in the session, 1801 s does not
    assert got == {("a", 1): 2, ("a", 2): 2, ("b", 1): 1, ("hot", 1): 2400, ("hot", 2): 1, ("hot", 3): 1}


def test_end_reasons(spark):
    seq = {"fin": ["x", "finish"], "fatal": ["x", "fatal", "finish"], "stop": ["x"] * 3, "max": ["x"] * 20,
           "late": ["x"] * 14 + ["finish"], "edge": ["x"] * 13 + ["finish"]}
    df = spark.createDataFrame([(k, i, a) for k, v in seq.items() for i, a in enumerate(v)], "s string, i int, a string")
    got = {r.s: (r.steps, r.reason) for r in T.end_reasons(df, "s", ["i"], F.col("a") == "finish", F.col("a") == "fatal").collect()}
    assert got == {"fin": (2, "finish"), "fatal": (2, "fatal"), "stop": (3, "stopped"), "max": (14, "exhausted"),
                   "late": (14, "exhausted"), "edge": (14, "finish")}


def test_containment_against_brute_force(spark):
    rng = random.Random(11)
    words = [rng.choice(["the", "of", "öl", "a", "tin", "zebra", "x-1", "né"]) for _ in range(40)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 60))).replace("zebra", "zeb\nra")) for i in range(150)]
    common = "shared passage that many copies of the text contain in full"
    texts += [(1000 + i, f"{i} {common} {i}") for i in range(80)]
    items = [(0, common), (1, common), (2, "the of"), (3, "tin"), (4, "zeb\nra"), (5, "abc"), (6, "öl a")]
    for j in range(60):
        t = rng.choice(texts)[1]
        a = rng.randint(0, max(0, len(t) - 8))
        items.append((10 + j, t[a:a + rng.randint(4, 50)]))
    got = containment(spark.createDataFrame(texts, "d int, t string"), ["d"], "t",
                      spark.createDataFrame(items, "i int, p string"), ["i"], "p")
    want = {(d, i) for d, t in texts for i, p in items if len(p) >= 4 and p in t}
    pairs = [(r.d, r.i) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("most", [512, 3])
def test_containment_in_scopes_of_any_size(spark, monkeypatch, most):
    from veilspark.operators import containment as module

    monkeypatch.setattr(module, "LISTED", most)  # with three, some sessions get lists and others anchors
    rng = random.Random(7)
    texts = [(f"s{i % 9}" if i % 9 else None, i, i % 5, "".join(rng.choice("ab 01X") for _ in range(80))) for i in range(120)]
    items = []
    for s, i, step, t in texts:
        for n in range(int(s[1:]) if s else 3):
            a = rng.randint(0, 70)
            items.append((s, f"t{i}.{n}", rng.randint(0, 4), t[a:a + rng.randint(2, 9)]))
    frames = spark.createDataFrame(texts, "s string, d int, step int, t string"), spark.createDataFrame(items, "s string, token string, known int, p string")
    for least in (4, 1):
        got = module.containment(frames[0], ["s", "d", "step"], "t", frames[1], ["s", "token", "known"], "p", scope=["s"], least=least, since=("known", "step"))
        pairs = [(r.d, r.token) for r in got.collect() if len(r.p) >= 4]
        want = {(d, token) for s, d, step, t in texts for z, token, known, p in items if s and s == z and known <= step and len(p) >= 4 and p in t}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want and want


def test_texts_of_small_scopes_are_not_cut_into_runs(spark):
    texts = spark.createDataFrame([(i // 4, i, 0, f"body of page {i} " * 90) for i in range(40)], "s int, d int, step int, t string")
    items = spark.createDataFrame([(i // 4, f"t{i}", 0, f"value-{i:04d}") for i in range(40)], "s int, token string, known int, p string")
    got = containment(texts, ["s", "d", "step"], "t", items, ["s", "token", "known"], "p", scope=["s"])
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_containment_within_a_scope(spark):
    texts = spark.createDataFrame([("s1", 1, "pass hunter22 now"), ("s2", 2, "pass hunter22 now")], "s string, d int, t string")
    items = spark.createDataFrame([("s1", "tok", "hunter22")], "s string, token string, p string")
    got = containment(texts, ["s", "d"], "t", items, ["s", "token"], "p", scope=["s"]).collect()
    assert [(r.s, r.d, r.token) for r in got] == [("s1", 1, "tok")]
    none = containment(texts, ["s", "d"], "t", items.filter("s = 'zz'"), ["s", "token"], "p", scope=["s"])
    assert none.count() == 0

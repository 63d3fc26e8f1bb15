import random
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions import boxlists as BL
from veilspark.functions import geometry as G
from veilspark.operators import boxes as B
from veilspark.operators import matching as M


def iou(a, b):
    inter = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - inter
    return (inter / union if union > 0 else 0.0), inter


def union(a, b):
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(1)
    return {p: [tuple(float(rng.randint(lo, hi)) for lo, hi in ((0, 300), (0, 300), (1, 200), (1, 200))) for _ in range(rng.randint(1, 9))]
            for p in range(60)}


@pytest.fixture(scope="module")
def table(spark, pages):
    rows = [(p, i, b, (i % 3) / 4, f"c{i}", "blur") for p, bs in pages.items() for i, b in enumerate(bs)]
    return spark.createDataFrame(rows, f"page int, pos int, box {G.BOX}, confidence double, pii_type string, mode string").cache()


def test_dedupe(pages, table):
    got = {}
    for r in B.deduped(table, "page").orderBy("page", "pos").collect():
        got.setdefault(r.page, []).append(tuple(r.box))
    for page, boxes in pages.items():
        kept = []
        for b in boxes:
            if all(iou(k, b)[0] < 0.25 for k in kept):
                kept.append(b)
        assert got[page] == kept


def test_merge_groups_are_greedy_and_keep_the_best(pages, table):
    got = {}
    for r in B.merged(table, "page").orderBy("page", "grp").collect():
        got.setdefault(r.page, []).append((tuple(r.box), r.pii_type))
    for page, boxes in pages.items():
        groups = []
        for i, b in enumerate(boxes):
            def near(j):
                v, inter = iou(boxes[j], b)
                return inter > 0 and (v >= 0.3 or inter / min(boxes[j][2] * boxes[j][3], b[2] * b[3]) >= 0.65)
            for g in groups:
                if any(near(j) for j in g):
                    g.append(i)
                    break
            else:
                groups.append([i])
        want = []
        for g in groups:
            box, best = boxes[g[0]], g[0]
            for j in g[1:]:
                box = union(box, boxes[j])
                best = j if j % 3 > best % 3 else best
            want.append((box, f"c{best}"))
        assert got[page] == want


def test_growing_union(pages, table):
    got = {}
    for r in B.unions(table, "page").orderBy("page", "ord").collect():
        got.setdefault(r.page, []).append(tuple(r.box))
    for page, boxes in pages.items():
        rest, want = list(boxes), []
        while rest:
            cur, left = rest[0], []
            for b in rest[1:]:
                if iou(cur, b)[0] >= 0.4:
                    cur = union(cur, b)
                else:
                    left.append(b)
            want.append(cur)
            rest = left
        assert got[page] == want


def test_overlap_join_gives_each_pair_once(pages, table):
    a = table.select("page", "pos", "box")
    b = a.select("page", F.col("pos").alias("other"), F.col("box").alias("other_box"))
    pairs = [(r.page, r.pos, r.other) for r in M.overlapping(a, "box", b, "other_box", ["page"]).collect()]
    want = {(p, i, j) for p, bs in pages.items() for i, x in enumerate(bs) for j, y in enumerate(bs) if iou(x, y)[1] > 0}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_bridging_box_joins_the_first_group_only(spark):
    rows = [(0, 0, (0.0, 0.0, 10.0, 10.0)), (0, 1, (12.0, 0.0, 10.0, 10.0)), (0, 2, (2.0, 0.0, 18.0, 10.0))]
    df = spark.createDataFrame([(*r, 0.5, "a", "blur") for r in rows], f"page int, pos int, box {G.BOX}, confidence double, pii_type string, mode string")
    got = [(r.grp, tuple(r.box)) for r in B.merged(df, "page").orderBy("grp").collect()]
    assert got == [(0, (0.0, 0.0, 20.0, 10.0)), (1, (12.0, 0.0, 10.0, 10.0))]


def test_scalar_geometry(spark):
    df = spark.createDataFrame([((-5.0, 790.0, 20.0, 20.0), (0.0, 0.0, 0.0, 0.0))], f"a {G.BOX}, z {G.BOX}")
    a, z = F.col("a"), F.col("z")
    r = df.select(G.clamp_box(a, 1280, 800).alias("c"), G.expand_box(a, 4, 1280, 800).alias("e"), G.iou(z, z).alias("i"),
                  G.round_half_up(F.lit(2.5)).alias("h"), G.round_half_up(F.lit(-2.5)).alias("n"),
                  G.linear_score(F.lit(155.0), 60, 250).alias("s")).first()
    assert tuple(r.c) == (0, 790, 15, 10) and tuple(r.e) == (0, 786, 19, 14)
    assert r.i == 0 and r.h == 3 and r.n == -2 and r.s == pytest.approx(0.5)


def test_fusion_scales_by_capture_size(spark):
    d = spark.createDataFrame([(1, (10.0, 20.0, 30.0, 40.0))], f"page int, box {G.BOX}")
    f = spark.createDataFrame([(1, 2560.0, 800.0, 1280.0, 0.0)], "page int, image_width double, image_height double, viewport_width double, viewport_height double")
    assert tuple(B.fused(d, f, "page").first().box) == (20.0, 16000.0, 60.0, 32000.0)


def _many(kind, n=10_000):
    rnd = random.Random(kind)
    if kind == "spread":
        return [(rnd.uniform(0, 5000), rnd.uniform(0, 5000), rnd.uniform(5, 60), rnd.uniform(5, 60)) for _ in range(n)]
    if kind == "one place":
        return [(10.0 + i % 3, 10.0, 50.0, 20.0) for i in range(n)]
    if kind == "some very large":
        return [(0.0, 0.0, 4000.0, 4000.0 - i) if i % 500 == 0 else (rnd.uniform(0, 4000), rnd.uniform(0, 4000), 20.0, 20.0) for i in range(n)]
    return [(i * 3.0, 0.0, 10.0, 10.0) for i in range(n)]  # a chain: each grows into the next


@pytest.mark.parametrize("kind", ["spread", "one place", "some very large", "chain"])
def test_ten_thousand_boxes_on_a_page(kind):
    boxes = _many(kind)
    begin = time.time()
    BL.kept(boxes, 0.5), BL.groups(boxes, 0.3, 0.7), BL.grown(boxes, 0.4)
    assert time.time() - begin < 20
    few = boxes[::25]
    for threshold in (0, 0.2, 0.5):
        want = []
        for i, b in enumerate(few):
            if not any(iou(few[k], b)[0] >= threshold for k in want):
                want.append(i)
        assert BL.kept(few, threshold) == want
        rest, grown = list(few), []
        while rest:
            cur, left = rest[0], []
            for b in rest[1:]:
                if iou(cur, b)[0] >= threshold:
                    cur = union(cur, b)
                else:
                    left.append(b)
            grown.append(cur)
            rest = left
        assert BL.grown(few, threshold) == grown


def test_boxes_with_missing_sides(spark):
    rows = [(0, 0, (0.0, 0.0, 10.0, 10.0)), (0, 1, (0.0, None, 10.0, 10.0)), (0, 2, (0.0, 0.0, 10.0, 10.0)), (1, 0, None), (None, 0, (0.0, 0.0, 5.0, 5.0))]
    df = spark.createDataFrame([(*r, 0.5, "a", "blur") for r in rows], f"page int, pos int, box {G.BOX}, confidence double, pii_type string, mode string")
    assert sorted((str(r.page), r.pos) for r in B.deduped(df, "page").collect()) == [("0", 0), ("0", 1), ("1", 0), ("None", 0)]

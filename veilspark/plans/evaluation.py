"""Scores: context, classes, redaction, resources, latency, and box operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import geometry as G
from veilspark.operators import boxes as B
from veilspark.operators import elements as E
from veilspark.operators import matching as M
from veilspark.operators import scoring as S
from veilspark.operators import sessions as T
from veilspark.operators.ranking import exact_rank_value
from veilspark.plans import derived as D
from veilspark.plans import sqlparts as Q
from veilspark.plans.registry import query
from veilspark.session import materialise

_PAGE = ["page_id"]


def element_table(spark, sf_dir) -> DataFrame:
    """The element table for jobs that read it in several branches."""
    return materialise(D.form_elements(spark, sf_dir), "elements")


def expected_keys(elements: DataFrame) -> DataFrame:
    return elements.filter(F.coalesce("visible", F.lit(True)) & ~F.col("tag").isin("img", "span")).select("page_id", "selector")


def reported_keys(elements: DataFrame) -> DataFrame:
    """Context of the detector with some rows missing and some strangers added."""
    seen = E.interactive_context(elements, "page_id").filter((F.col("page_id") + F.col("pos")) % 19 != 0)
    ghosts = elements.filter((F.col("page_id") % 23 == 0) & (F.col("pos") == 0)).select(
        "page_id", F.lit("#ghost").alias("selector")
    )
    return seen.select("page_id", "selector").unionByName(ghosts)


_KEYS = f"""expected AS (SELECT DISTINCT page_id, coalesce(selector, '') AS selector FROM form_elements WHERE visible AND tag NOT IN ('img', 'span')),
reported AS (
    SELECT DISTINCT page_id, selector FROM form_elements WHERE visible AND w >= 2 AND h >= 2 AND (page_id + pos) % 19 <> 0
        AND (tag IN {Q._in(fixed.INTERACTIVE_TAGS)} OR coalesce(role, '') IN {Q._in(fixed.INTERACTIVE_ROLES)})
    UNION SELECT page_id, '#ghost' FROM form_elements WHERE page_id % 23 = 0 AND pos = 0)"""
_SCORES = """tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall,
    round(2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn))
          / greatest(1e-9, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)), 9) AS f1"""


@query(
    "context_f1",
    Q.with_ctes(
        Q.FORM, _KEYS,
        """m AS (SELECT page_id, e.selector IS NOT NULL AS e, r.selector IS NOT NULL AS r
             FROM expected e FULL OUTER JOIN reported r USING (page_id, selector))""",
        """c AS (SELECT page_id, count(*) FILTER (WHERE e AND r) AS tp, count(*) FILTER (WHERE r AND NOT e) AS fp,
             count(*) FILTER (WHERE e AND NOT r) AS fn FROM m GROUP BY ROLLUP (page_id))""",
        select=f"SELECT page_id, tp, fp, fn, {_SCORES} FROM c",
    ),
)
def context_f1(spark, sf_dir):
    elements = element_table(spark, sf_dir)
    flags = M.set_match(expected_keys(elements), reported_keys(elements), _PAGE, "selector")
    return M.with_scores(M.match_counts(flags, "page_id")).withColumn("f1", F.round("f1", 9))


@query(
    "key_set_ops",
    Q.with_ctes(
        Q.FORM, _KEYS,
        select="""SELECT 'both' AS part, page_id, selector FROM (SELECT * FROM expected INTERSECT SELECT * FROM reported)
        UNION ALL SELECT 'missing', page_id, selector FROM (SELECT * FROM expected EXCEPT SELECT * FROM reported)
        UNION ALL SELECT 'extra', page_id, selector FROM (SELECT * FROM reported EXCEPT SELECT * FROM expected)
        UNION ALL SELECT 'all', page_id, selector FROM (SELECT * FROM expected UNION SELECT * FROM reported)""",
    ),
)
def key_set_ops(spark, sf_dir):
    elements = element_table(spark, sf_dir)
    flags = M.set_match(expected_keys(elements), reported_keys(elements), _PAGE, "selector")
    e, r = F.col("expected"), F.col("reported")
    # intersect, both differences and union from one match instead of four set jobs
    part = F.when(e & r, "both").when(e, "missing").otherwise("extra")
    return flags.select(F.explode(F.array(part, F.lit("all"))).alias("part"), "page_id", "selector")


def gt_faces(elements: DataFrame) -> DataFrame:
    r = F.col("rect")
    return elements.filter(
        F.col("gt_class").isNotNull() & F.col("visible") & (r["width"] > 0) & (F.col("page_id") % 3 == 0) & (F.col("pos") % 4 == 0)
    ).select(
        "page_id", F.col("pos").alias("face_id"),
        G.box(r["x"] + 22, r["y"] + 6, r["width"] - 62, r["height"] + 42).alias("face_box"),
    )


_IOU = "CASE WHEN {a}.w * {a}.h + {b}.w * {b}.h - {i} <= 0 THEN 0 ELSE {i} / ({a}.w * {a}.h + {b}.w * {b}.h - {i}) END"


def _inter(a: str, b: str) -> str:
    return (
        f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * "
        f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    )


def _iou(a: str, b: str) -> str:
    return "(" + _IOU.format(a=a, b=b, i=_inter(a, b)) + ")"


_BOXES = f"""boxes AS ({D.SHIFTED_SQL}),
faces AS (
    SELECT page_id, pos AS face_id, x + 22.0::DOUBLE AS x, y + 6.0::DOUBLE AS y, w - 62.0::DOUBLE AS w, h + 42.0::DOUBLE AS h
    FROM form_elements WHERE gt_class IS NOT NULL AND visible AND w > 0 AND page_id % 3 = 0 AND pos % 4 = 0),
gt AS (SELECT page_id, pos AS gt_pos, selector, tag, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y,
              CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h
       FROM form_elements WHERE gt_class IS NOT NULL AND visible AND w > 0)"""


def detected(elements: DataFrame) -> DataFrame:
    return D.shifted(elements)


@query(
    "face_match",
    Q.with_ctes(
        Q.FORM, _BOXES,
        select=f"""SELECT b.page_id, b.pos, round(coalesce(max({_iou('b', 'f')}), 0), 9) AS best_iou
        FROM boxes b LEFT JOIN faces f ON f.page_id = b.page_id GROUP BY b.page_id, b.pos""",
    ),
)
def face_match(spark, sf_dir):
    elements = element_table(spark, sf_dir)
    best = M.best_overlap(detected(elements), "pos", "box", gt_faces(elements), "face_id", "face_box", _PAGE)
    return best.select("page_id", "pos", F.round("best_iou", 9).alias("best_iou"))


@query(
    "pii_f1",
    Q.with_ctes(
        Q.FORM, _BOXES,
        f"""best AS (SELECT b.page_id, b.pos, b.selector, max({{'iou': {_iou('b', 'f')}, 'id': f.face_id}}) AS m
            FROM boxes b LEFT JOIN faces f ON f.page_id = b.page_id GROUP BY ALL)""",
        f"""hits AS (SELECT page_id, pos, CASE WHEN EXISTS (SELECT 1 FROM gt WHERE gt.page_id = best.page_id
                AND gt.selector = best.selector AND gt.selector <> '') THEN selector
                WHEN m.iou >= {fixed.FACE_IOU} THEN concat('face[', m.id, ']') END AS hit FROM best)""",
        """truth AS (SELECT page_id, selector AS key FROM gt UNION SELECT page_id, concat('face[', face_id, ']') FROM faces)""",
        """c AS (SELECT (SELECT count(*) FROM hits WHERE hit IS NOT NULL) AS tp, (SELECT count(*) FROM hits WHERE hit IS NULL) AS fp,
             (SELECT count(*) FROM truth t WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.page_id = t.page_id AND h.hit = t.key)) AS fn)""",
        select=f"SELECT tp, fp, fn, {_SCORES} FROM c",
    ),
)
def pii_f1(spark, sf_dir):
    counts = pii_counts(element_table(spark, sf_dir))
    return M.with_scores(counts).withColumn("f1", F.round("f1", 9))


def sensitive(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("gt_class").isNotNull() & F.col("visible") & (F.col("rect.width") > 0))


def pii_counts(elements: DataFrame) -> DataFrame:
    return S.class_match_counts(sensitive(elements), gt_faces(elements), detected(elements), _PAGE)


_APPLIED = """applied AS (
    SELECT page_id, pos, x1 AS x, y1 AS y, floor(x2 - x1_raw + 0.5) AS w, floor(y2 - y1_raw + 0.5) AS h FROM (
        SELECT page_id, pos, floor(greatest(0, least(1280, x - 4)) + 0.5) AS x1, greatest(0, least(1280, x - 4)) AS x1_raw,
               floor(greatest(0, least(800, y - 4)) + 0.5) AS y1, greatest(0, least(800, y - 4)) AS y1_raw,
               greatest(0, least(1280, x + w + 4)) AS x2, greatest(0, least(800, y + h + 4)) AS y2 FROM boxes))"""


def applied(elements: DataFrame) -> DataFrame:
    found = detected(elements).withColumn("mode", F.lit("blackout"))
    w, h = fixed.DEFAULT_VIEWPORT
    return B.redaction_boxes(found, float(w), float(h))


def gt_regions(elements: DataFrame) -> DataFrame:
    return sensitive(elements).select("page_id", F.col("pos").alias("gt_pos"), F.col("rect").alias("gt_box"))


_REGIONS = f"""regions AS (
    SELECT g.page_id, g.gt_pos, coalesce(max({_iou('g', 'a')}), 0) AS best_iou,
           least(1, coalesce(sum({_inter('g', 'a')}), 0) / greatest(1e-9, any_value(g.w * g.h))) AS coverage
    FROM gt g LEFT JOIN applied a ON a.page_id = g.page_id GROUP BY g.page_id, g.gt_pos)"""


@query(
    "redaction_regions",
    Q.with_ctes(
        Q.FORM, _BOXES, _APPLIED, _REGIONS,
        select="SELECT page_id, gt_pos, round(best_iou, 9) AS best_iou, round(coverage, 9) AS coverage FROM regions",
    ),
)
def redaction_regions(spark, sf_dir):
    elements = element_table(spark, sf_dir)
    return S.region_quality(gt_regions(elements), applied(elements), _PAGE).select(
        "page_id", "gt_pos", F.round("best_iou", 9).alias("best_iou"), F.round("coverage", 9).alias("coverage")
    )


_OVERMASK = f"""ub AS (SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM applied GROUP BY 1),
ug AS (SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM gt GROUP BY 1),
om AS (SELECT sum(greatest(0, ub.w * ub.h - {_inter('ub', 'ug')})) / greatest(1e-9, sum(ub.w * ub.h)) AS overmask
       FROM ub JOIN ug USING (page_id)),
m3 AS (SELECT (SELECT avg(best_iou) FROM regions) AS mean_iou, (SELECT avg(coverage) FROM regions) AS mean_coverage, overmask,
              greatest(0, least(0.5, (overmask - 0.10) / 0.40)) AS penalty,
              (SELECT bool_and(page_id % 1000 <> 999) FROM gt) AS gates_ok FROM om)"""


def redaction_parts(elements: DataFrame) -> DataFrame:
    gates = sensitive(elements).select("page_id", (F.col("page_id") % 1000 != 999).alias("ok"))
    return S.redaction_summary(gt_regions(elements), applied(elements), gates, _PAGE)


@query(
    "redaction_score",
    Q.with_ctes(
        Q.FORM, _BOXES, _APPLIED, _REGIONS, _OVERMASK,
        select="""SELECT round(mean_iou, 6) AS mean_iou, round(mean_coverage, 6) AS mean_coverage, round(overmask, 6) AS overmask,
        round(penalty, 6) AS penalty, gates_ok,
        round(100 * (0.45 * mean_iou + 0.55 * mean_coverage) * (1 - penalty), 6) AS ungated,
        CASE WHEN gates_ok THEN round(100 * (0.45 * mean_iou + 0.55 * mean_coverage) * (1 - penalty), 6) ELSE 0 END AS score FROM m3""",
    ),
)
def redaction_score(spark, sf_dir):
    p = redaction_parts(element_table(spark, sf_dir))
    rounded = ("mean_iou", "mean_coverage", "overmask", "penalty", "ungated", "score")
    return p.select("gates_ok", *[F.round(c, 6).alias(c) for c in rounded])


_LAT = "floor((capture_ms + dom_ms + perception_ms + redaction_ms + network_ms + coalesce(exec_ms, 0)) * 10 + 0.5) / 10"
_M45 = f"""tel AS ({D.TELEMETRY_SQL}),
m45 AS (SELECT avg(60 + perception_ms) AS heap, avg(perception_ms * 10) AS infer, avg(redaction_ms * 10) AS redact,
               avg(network_ms * 10) AS server FROM tel),
s45 AS (SELECT 100 * (0.5 * (1 - greatest(0, least(1, (heap - 60) / 190))) + 0.5 * (1 - greatest(0, least(1, (infer - 150) / 550)))) AS resource,
               100 * (1 - greatest(0, least(1, (infer + redact + server - 600) / 1900))) AS latency,
               infer + redact + server AS cycle_ms, heap, infer FROM m45)"""


def speed_scores(spark, sf_dir) -> DataFrame:
    return S.speed_scores(
        D.telemetry(spark, sf_dir),
        60 + F.col("perception_ms"),
        F.col("perception_ms") * 10,
        F.col("redaction_ms") * 10,
        F.col("network_ms") * 10,
    )


@query(
    "latency_score",
    Q.with_ctes(_M45, select="SELECT round(resource, 6) AS resource, round(latency, 6) AS latency, round(cycle_ms, 6) AS cycle_ms FROM s45"),
)
def latency_score(spark, sf_dir):
    return speed_scores(spark, sf_dir).select(*[F.round(c, 6).alias(c) for c in ("resource", "latency", "cycle_ms")])


@query(
    "composite",
    Q.with_ctes(
        Q.FORM, _KEYS, _BOXES, _APPLIED, _REGIONS, _OVERMASK, _M45,
        """k AS (SELECT count(*) FILTER (WHERE e.selector IS NOT NULL AND r.selector IS NOT NULL) AS tp,
             count(*) FILTER (WHERE e.selector IS NULL) AS fp, count(*) FILTER (WHERE r.selector IS NULL) AS fn
             FROM expected e FULL OUTER JOIN reported r USING (page_id, selector))""",
        f"""best AS (SELECT b.page_id, b.pos, b.selector, max({{'iou': {_iou('b', 'f')}, 'id': f.face_id}}) AS m
            FROM boxes b LEFT JOIN faces f ON f.page_id = b.page_id GROUP BY ALL)""",
        f"""hits AS (SELECT page_id, pos, CASE WHEN EXISTS (SELECT 1 FROM gt WHERE gt.page_id = best.page_id
                AND gt.selector = best.selector AND gt.selector <> '') THEN selector
                WHEN m.iou >= {fixed.FACE_IOU} THEN concat('face[', m.id, ']') END AS hit FROM best)""",
        """truth AS (SELECT page_id, selector AS key FROM gt UNION SELECT page_id, concat('face[', face_id, ']') FROM faces)""",
        """p AS (SELECT (SELECT count(*) FROM hits WHERE hit IS NOT NULL) AS tp, (SELECT count(*) FROM hits WHERE hit IS NULL) AS fp,
             (SELECT count(*) FROM truth t WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.page_id = t.page_id AND h.hit = t.key)) AS fn)""",
        """m AS (SELECT 'm1' AS metric, 100 * 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS score FROM k
           UNION ALL SELECT 'm2', 100 * 2.0::DOUBLE * tp / (2 * tp + fp + fn) FROM p
           UNION ALL SELECT 'm3', CASE WHEN gates_ok THEN 100 * (0.45 * mean_iou + 0.55 * mean_coverage) * (1 - penalty) ELSE 0 END FROM m3
           UNION ALL SELECT 'm4', resource FROM s45 UNION ALL SELECT 'm5', latency FROM s45)""",
        select=f"""SELECT metric, round(score, 6) AS score FROM m UNION ALL
        SELECT 'composite', round(sum(score * {Q.case_of('metric', fixed.METRIC_WEIGHTS, quote=False)}), 6) FROM m""",
    ),
)
def composite(spark, sf_dir):
    elements = element_table(spark, sf_dir)
    flags = M.set_match(expected_keys(elements), reported_keys(elements), _PAGE, "selector")
    context = M.with_scores(M.match_counts(flags, "page_id").filter(F.col("page_id").isNull()))
    classes = M.with_scores(pii_counts(elements))
    scores = S.composite(
        S.metric_rows(context, m1=100 * F.col("f1")),
        S.metric_rows(classes, m2=100 * F.col("f1")),
        S.metric_rows(redaction_parts(elements), m3=F.col("score")),
        S.metric_rows(speed_scores(spark, sf_dir), m4=F.col("resource"), m5=F.col("latency")),
    )
    return scores.withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------------------
# box operators
# ---------------------------------------------------------------------------
@query(
    "union_box",
    Q.with_ctes(
        Q.FORM, _BOXES,
        select="SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height FROM boxes GROUP BY page_id",
    ),
)
def union_box(spark, sf_dir):
    return B.union_per(detected(D.form_elements(spark, sf_dir)), "page_id").select("page_id", "box.*")


@query(
    "box_iou",
    Q.with_ctes(
        Q.FORM, _BOXES,
        select=f"""SELECT a.page_id, a.pos AS pos, b.pos AS other, round({_iou('a', 'b')}, 9) AS iou, {_inter('a', 'b')} AS overlap,
        round({_inter('a', 'b')} / least(a.w * a.h, b.w * b.h), 9) AS containment
        FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.pos < b.pos WHERE {_inter('a', 'b')} > 0""",
    ),
)
def box_iou(spark, sf_dir):
    found = detected(element_table(spark, sf_dir)).select("page_id", "pos", "box")
    other = found.select("page_id", F.col("pos").alias("other"), F.col("box").alias("other_box"))
    pairs = M.overlapping(found, "box", other, "other_box", _PAGE).filter(F.col("pos") < F.col("other"))
    a, b = F.col("box"), F.col("other_box")
    return pairs.select(
        "page_id", "pos", "other", F.round(G.iou(a, b), 9).alias("iou"), G.overlap_area(a, b).alias("overlap"),
        F.round(G.containment(a, b), 9).alias("containment"),
    )


@query(
    "box_clamp",
    Q.with_ctes(Q.FORM, _BOXES, _APPLIED, select="SELECT page_id, pos, x, y, w AS width, h AS height FROM applied WHERE w >= 1 AND h >= 1"),
)
def box_clamp(spark, sf_dir):
    return applied(D.form_elements(spark, sf_dir)).select("page_id", "pos", "box.*")


@query(
    "box_fuse",
    Q.with_ctes(
        Q.FORM, _BOXES,
        select="""SELECT page_id, pos, x * sx AS x, y * sx AS y, w * sx AS width, h * sx AS height
        FROM (SELECT *, (1280 * (1 + page_id % 3)) / 1280.0::DOUBLE AS sx FROM boxes)""",
    ),
)
def box_fuse(spark, sf_dir):
    found = detected(D.form_elements(spark, sf_dir)).select("page_id", "pos", "box")
    scale = (1 + F.col("c_custkey") % 3).cast("double")
    frames = D.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page_id"), (1280 * scale).alias("image_width"), (800 * scale).alias("image_height"),
        F.lit(1280.0).alias("viewport_width"), F.lit(800.0).alias("viewport_height"),
    )
    return B.fused(found, frames, "page_id").select("page_id", "pos", "box.*")


_LB = "lb AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i FROM boxes)"


def _list_iou(k: str, b: str) -> str:
    inter = (
        f"(greatest(0, least({k}.x + {k}.w, {b}.x + {b}.w) - greatest({k}.x, {b}.x)) * "
        f"greatest(0, least({k}.y + {k}.h, {b}.y + {b}.h) - greatest({k}.y, {b}.y)))"
    )
    return f"({inter} / ({k}.w * {k}.h + {b}.w * {b}.h - {inter}))", inter


_D_IOU, _ = _list_iou("kk", "b")


@query(
    "box_dedupe",
    "WITH RECURSIVE " + ",\n".join([
        Q.FORM, _BOXES, _LB,
        f"""st AS (SELECT page_id, 1 AS i, [{{'pos': pos, 'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM lb WHERE i = 1
        UNION ALL SELECT st.page_id, st.i + 1, CASE WHEN len(list_filter(kept, lambda kk: {_D_IOU} >= {fixed.DEDUPE_IOU})) > 0 THEN kept
            ELSE list_append(kept, {{'pos': b.pos, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) END
        FROM st JOIN lb b ON b.page_id = st.page_id AND b.i = st.i + 1)""",
    ]) + """ SELECT page_id, unnest(list_transform(kept, lambda kk: kk.pos)) AS pos FROM st
    WHERE i = (SELECT max(i) FROM lb WHERE lb.page_id = st.page_id)""",
)
def box_dedupe(spark, sf_dir):
    found = detected(D.form_elements(spark, sf_dir)).withColumn("mode", F.lit("blackout"))
    return B.deduped(found, "page_id").select("page_id", "pos")


_M_IOU, _M_INTER = _list_iou("mm", "b")


@query(
    "box_merge",
    "WITH RECURSIVE " + ",\n".join([
        Q.FORM, _BOXES, _LB,
        f"""st AS (SELECT page_id, 1 AS i, [[{{'pos': pos, 'x': x, 'y': y, 'w': w, 'h': h, 'c': confidence}}]] AS g FROM lb WHERE i = 1
        UNION ALL SELECT page_id, i + 1, CASE WHEN coalesce(slot, 0) = 0 THEN list_append(g, [d])
            ELSE list_transform(g, lambda gg, gi: CASE WHEN gi = slot THEN list_append(gg, d) ELSE gg END) END
        FROM (SELECT st.page_id, st.i, st.g, {{'pos': b.pos, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h, 'c': b.confidence}} AS d,
                     list_position(list_transform(g, lambda gg: len(list_filter(gg, lambda mm: {_M_INTER} > 0 AND
                        ({_M_IOU} >= {fixed.MERGE_IOU} OR {_M_INTER} / least(mm.w * mm.h, b.w * b.h) >= {fixed.MERGE_CONTAINMENT}))) > 0), true) AS slot
              FROM st JOIN lb b ON b.page_id = st.page_id AND b.i = st.i + 1))""",
        """fin AS (SELECT page_id, unnest(g) AS gg, unnest(range(len(g))) AS grp FROM st
            WHERE i = (SELECT max(i) FROM lb WHERE lb.page_id = st.page_id))""",
    ]) + """ SELECT page_id, grp, len(gg) AS members, list_min(list_transform(gg, lambda mm: mm.x)) AS x,
        list_min(list_transform(gg, lambda mm: mm.y)) AS y,
        list_max(list_transform(gg, lambda mm: mm.x + mm.w)) - list_min(list_transform(gg, lambda mm: mm.x)) AS width,
        list_max(list_transform(gg, lambda mm: mm.y + mm.h)) - list_min(list_transform(gg, lambda mm: mm.y)) AS height,
        round(list_max(list_transform(gg, lambda mm: mm.c)), 6) AS confidence FROM fin""",
)
def box_merge(spark, sf_dir):
    found = detected(D.form_elements(spark, sf_dir)).withColumn("mode", F.lit("blackout"))
    return B.merged(found, "page_id").select("page_id", "grp", "members", "box.*", F.round("confidence", 6).alias("confidence"))


_C_IOU, _ = _list_iou("cur", "b")
_NEW_CUR = """{'x': least(cur.x, b.x), 'y': least(cur.y, b.y), 'w': greatest(cur.x + cur.w, b.x + b.w) - least(cur.x, b.x),
    'h': greatest(cur.y + cur.h, b.y + b.h) - least(cur.y, b.y)}"""


@query(
    "box_growing_union",
    "WITH RECURSIVE " + ",\n".join([
        Q.FORM, _BOXES,
        "al AS (SELECT page_id, list({'x': x, 'y': y, 'w': w, 'h': h} ORDER BY pos) AS bs FROM boxes GROUP BY page_id)",
        f"""st AS (SELECT page_id, bs[1] AS cur, bs[2:] AS rest, bs[1:0] AS skipped, bs[1:0] AS done FROM al
        UNION ALL SELECT page_id,
            CASE WHEN len(rest) > 0 THEN CASE WHEN {_C_IOU} >= {fixed.UNION_IOU} THEN {_NEW_CUR} ELSE cur END ELSE skipped[1] END,
            CASE WHEN len(rest) > 0 THEN rest[2:] ELSE skipped[2:] END,
            CASE WHEN len(rest) > 0 THEN CASE WHEN {_C_IOU} >= {fixed.UNION_IOU} THEN skipped ELSE list_append(skipped, b) END
                 ELSE skipped[1:0] END,
            CASE WHEN len(rest) > 0 THEN done ELSE list_append(done, cur) END
        FROM (SELECT *, rest[1] AS b FROM st WHERE cur IS NOT NULL))""",
    ]) + """ SELECT page_id, i - 1 AS ord, done[i].x AS x, done[i].y AS y, done[i].w AS width, done[i].h AS height
    FROM (SELECT page_id, done, unnest(range(1, len(done) + 1)) AS i FROM st WHERE cur IS NULL)""",
)
def box_growing_union(spark, sf_dir):
    found = detected(D.form_elements(spark, sf_dir)).withColumn("mode", F.lit("blackout"))
    return B.unions(found, "page_id").select("page_id", "ord", "box.*")


# ---------------------------------------------------------------------------
# latency and sessions
# ---------------------------------------------------------------------------
_TEL = f"tel AS (SELECT *, {_LAT} AS total_ms FROM ({D.TELEMETRY_SQL}))"


@query(
    "latency_p95",
    Q.with_ctes(
        _TEL,
        """r AS (SELECT event_type, total_ms, row_number() OVER (PARTITION BY event_type ORDER BY total_ms) - 1 AS i,
             count(*) OVER (PARTITION BY event_type) AS n FROM tel)""",
        select="SELECT event_type, n, total_ms AS p95 FROM r WHERE i = greatest(floor(n * 0.95::DOUBLE) - 1, 0)",
    ),
)
def latency_p95(spark, sf_dir):
    t = D.telemetry(spark, sf_dir).select("event_type", T.total_ms().alias("total_ms"))
    return exact_rank_value(t, ["event_type"], "total_ms", F.floor(F.col("n") * F.lit(0.95)) - 1, "p95", width=10.0)


@query(
    "slow_steps",
    Q.with_ctes(
        _TEL,
        select=f"""SELECT session_id, count(*) AS steps, round(avg(total_ms), 9) AS mean_ms, max(total_ms) AS worst_ms,
        count(*) FILTER (WHERE total_ms > {fixed.SLOW_STEP_MS}) AS slow_steps, arg_max(step, (ts, event_id)) AS latest_step,
        arg_max(total_ms, (ts, event_id)) AS latest_ms FROM tel GROUP BY session_id""",
    ),
)
def slow_steps(spark, sf_dir):
    t = T.telemetry_by_session(D.telemetry(spark, sf_dir), "session_id", "ts", "event_id")
    return t.withColumn("mean_ms", F.round("mean_ms", 9))


@query(
    "sessionize",
    f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {fixed.SESSION_IDLE_SECONDS} SECOND THEN 0 ELSE 1 END AS fresh
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM e)
    SELECT user_id, session_no, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events FROM n GROUP BY ALL""",
)
def sessionize(spark, sf_dir):
    e = D.load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return T.idle_sessions(e, "user_id", "ts").select(
        "user_id", "session_no", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "events"
    )


@query(
    "step_budget",
    f"""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    u AS (SELECT * FROM r WHERE rn <= {fixed.STEP_BUDGET}),
    s AS (SELECT user_id, max(rn) AS seen, min(rn) FILTER (WHERE event_type IN ('signup', 'error')) AS stop FROM u GROUP BY user_id)
    SELECT s.user_id, coalesce(stop, seen) AS steps, CASE WHEN u.event_type = 'error' THEN 'fatal' WHEN u.event_type = 'signup' THEN 'finish'
        WHEN seen >= {fixed.STEP_BUDGET} THEN 'exhausted' ELSE 'stopped' END AS reason
    FROM s LEFT JOIN u ON u.user_id = s.user_id AND u.rn = s.stop""",
)
def step_budget(spark, sf_dir):
    e = D.load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return T.end_reasons(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error")


@query(
    "inspector_rows",
    Q.with_ctes(
        _TEL,
        f"""r AS (SELECT session_id, event_id, step, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS rank FROM tel)""",
        select=f"SELECT * FROM r WHERE rank <= {fixed.INSPECTOR_ROWS}",
    ),
)
def inspector_rows(spark, sf_dir):
    """The newest steps of each session."""
    t = D.telemetry(spark, sf_dir).select("session_id", "ts", "event_id", "step")
    return T.newest(t, "session_id", ["ts", "event_id"]).drop("ts")


@query(
    "restart_runs",
    Q.with_ctes(
        _TEL,
        """r AS (SELECT session_id, ts, sum(CASE WHEN step = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id
             ROWS UNBOUNDED PRECEDING) AS run FROM tel)""",
        select="SELECT session_id, run, count(*) AS steps, epoch_us(min(ts)) AS start_us FROM r GROUP BY ALL",
    ),
)
def restart_runs(spark, sf_dir):
    t = D.telemetry(spark, sf_dir).select("session_id", "ts", "event_id", "step")
    return (
        T.restart_runs(t, "session_id", "ts", "event_id", "step")
        .groupBy("session_id", "run")
        .agg(F.count("*").alias("steps"), F.unix_micros(F.min("ts")).alias("start_us"))
    )

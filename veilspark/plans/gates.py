"""The redaction score with the verdicts of the steps themselves as its gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import patterns as P
from veilspark.operators import flow as W
from veilspark.operators import images as I
from veilspark.operators import scoring as S
from veilspark.operators import vault as V
from veilspark.plans import evaluation as E
from veilspark.plans import imaging as G
from veilspark.plans import sqlparts as Q
from veilspark.plans.forms import tagged
from veilspark.plans.registry import query
from veilspark.session import grows, materialise

LEAST_CHANGE = 20
_TASK = "'Fill the form'"

_CLEAN = f"""payloads AS (
    SELECT session_id, page_id, step, CAST(to_json({{'task': {_TASK},
        'dom_elements': list({{'pos': pos, 'tag': tag, 'type': type, 'id': id, 'name': name, 'selector': selector,
            'text': text, 'label': label, 'aria_label': aria_label, 'autocomplete': autocomplete, 'role': role,
            'value': value}} ORDER BY pos), 'step_index': step, 'session_id': concat('s', session_id)}}) AS VARCHAR) AS body
    FROM sanitised GROUP BY session_id, page_id, step)"""
_STRIPPED = r"(SELECT page_id, regexp_replace(body, '" + fixed.TOKEN_BRACKETED + r"', '[]', 'g') AS body FROM payloads)"
_GATES = rf"""{_CLEAN},
shown AS (SELECT DISTINCT page_id FROM ({Q.findings(_STRIPPED, 'body', 'page_id')})),
leaked AS (SELECT DISTINCT p.page_id FROM payloads p JOIN tokenised t ON t.session_id = p.session_id AND t.step <= p.step
    JOIN vault v ON v.session_id = t.session_id AND v.token = t.token
    WHERE length(v.raw_value) >= 4 AND contains(p.body, v.raw_value)),
{G._PX}, {G._BOX}, {G._DARK},
flat AS (SELECT image_id, avg(l) < {fixed.DARK_MEAN} AND var_pop(l) < {fixed.FLAT_VARIANCE} AS verified
    FROM (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS l FROM dark WHERE inside)
    WHERE (x - tx) % greatest(1, least(tw, th) // 8) = 0 AND (y - ty) % greatest(1, least(tw, th) // 8) = 0 GROUP BY image_id),
cellmean AS (SELECT image_id, avg(r) + avg(g) + avg(b) AS change FROM inb WHERE inside
    GROUP BY image_id, (x - tx) * 16 // tw, (y - ty) * 16 // th),
changed AS (SELECT image_id, avg(change) >= {LEAST_CHANGE} AS changed FROM cellmean GROUP BY image_id),
gates AS (SELECT p.page_id, coalesce(verified, false) AS verified, coalesce(changed, false) AS changed,
        p.page_id NOT IN (SELECT page_id FROM shown) AND p.page_id NOT IN (SELECT page_id FROM leaked) AS leak_free
    FROM payloads p LEFT JOIN flat f ON f.image_id = p.page_id LEFT JOIN changed c ON c.image_id = p.page_id)"""


def page_gates(spark, sf_dir) -> DataFrame:
    """page_id, verified, changed, leak_free: what the redacted image and the outgoing payload of each page say."""
    t = tagged(spark, sf_dir)
    tokenised = materialise(V.tokens(t), "tokens")
    bodies = materialise(W.payload_bodies(V.sanitised_elements(t, tokenised), F.lit("Fill the form")), "payloads")
    leaks = W.vault_leaks(bodies, tokenised).select("page_id").distinct().withColumn("leaked", F.lit(True))
    shot = I.redact_images(G.rasters(spark, sf_dir), G.fixed_boxes(spark, sf_dir, "blackout")).select(
        F.col("image_id").alias("page_id"), "verified", (F.col("least_change") >= LEAST_CHANGE).alias("changed")
    )
    shown = F.size(P.scan_text(P.strip_tokens(F.col("body")))) > 0
    return grows(grows(bodies.select("page_id", shown.alias("shown"))).join(leaks, "page_id", "left")).join(shot, "page_id", "left").select(
        "page_id", F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("changed", F.lit(False)).alias("changed"),
        (~F.col("shown") & F.col("leaked").isNull()).alias("leak_free"),
    )


@query("redaction_gates", Q.with_ctes(Q.FORM, Q.CLASSIFIED, Q.TOKENISED, _GATES, select="SELECT page_id, verified, changed, leak_free FROM gates"))
def redaction_gates(spark, sf_dir):
    return page_gates(spark, sf_dir)


@query(
    "gated_score",
    Q.with_ctes(
        Q.FORM, Q.CLASSIFIED, Q.TOKENISED, _GATES, E._BOXES, E._APPLIED, E._REGIONS,
        f"""ub AS (SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM applied GROUP BY 1),
        ug AS (SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM gt GROUP BY 1),
        om AS (SELECT page_id % 4 AS template, sum(greatest(0, ub.w * ub.h - {E._inter('ub', 'ug')})) / greatest(1e-9, sum(ub.w * ub.h)) AS overmask
               FROM ub JOIN ug USING (page_id) GROUP BY ALL),
        rq AS (SELECT page_id % 4 AS template, avg(best_iou) AS mean_iou, avg(coverage) AS mean_coverage FROM regions GROUP BY ALL),
        gs AS (SELECT page_id % 4 AS template, bool_and(verified AND changed AND leak_free) AS gates_ok FROM gates
               WHERE page_id IN (SELECT page_id FROM gt) GROUP BY ALL)""",
        select="""SELECT CAST(template AS INTEGER) AS template, gates_ok, round(mean_iou, 6) AS mean_iou, round(mean_coverage, 6) AS mean_coverage,
            round(CASE WHEN gates_ok THEN 100 * (0.45 * mean_iou + 0.55 * mean_coverage) * (1 - greatest(0, least(0.5, (overmask - 0.10) / 0.40)))
                  ELSE 0 END, 6) AS score
        FROM rq JOIN om USING (template) JOIN gs USING (template)""",
    ),
)
def gated_score(spark, sf_dir):
    """Redaction score of each form template; a page whose image or payload fails closes its template's gate."""
    elements = E.element_table(spark, sf_dir)
    gates = page_gates(spark, sf_dir).select("page_id", (F.col("verified") & F.col("changed") & F.col("leak_free")).alias("ok"))
    truth = E.gt_regions(elements).withColumn("template", (F.col("page_id") % 4).cast("int"))
    p = S.redaction_summary(truth, E.applied(elements), gates, ["page_id"], by=["template"])
    return p.select("template", "gates_ok", *[F.round(c, 6).alias(c) for c in ("mean_iou", "mean_coverage", "score")])

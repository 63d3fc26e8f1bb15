"""The compliance report: what an audit says about a payload, its elements and its screenshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import images as I
from veilspark.plans import imaging as G
from veilspark.plans import payloads as L
from veilspark.plans import sqlparts as Q
from veilspark.plans.registry import CHECK_SQL, query
from veilspark.session import grows

_PAM_BYTES = 67 + 4 * G.SIDE * G.SIDE  # header and pixels
_BASE64 = 4 * -(-_PAM_BYTES // 3)


@query(
    "compliance_report",
    Q.with_ctes(
        G._PX, G._BOX, G._DARK,
        "m AS (SELECT image_id, x // 8 AS cx, y // 8 AS cy, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM dark GROUP BY ALL)",
        "black AS (SELECT image_id, avg(CASE WHEN r < 12 AND g < 12 AND b < 12 THEN 1.0::DOUBLE ELSE 0 END) AS ratio FROM m GROUP BY image_id)",
        select=f"""SELECT c.*, c.page_id % 6 <> 0 AS present, CASE c.page_id % 6 WHEN 0 THEN 0 WHEN 1 THEN round_even(300 / 1024, 1)
            ELSE round_even({_BASE64} / 1024, 1) END AS kb,
            CASE WHEN c.page_id % 6 > 1 THEN {G.SIDE} END AS width, CASE WHEN c.page_id % 6 > 1 THEN round(ratio, 4) END AS black_ratio,
            c.page_id % 6 = 1 AS unreadable
        FROM ({CHECK_SQL['payload_compliance']}) c LEFT JOIN black b ON b.image_id = c.page_id""",
    ),
)
def compliance_report(spark, sf_dir):
    """Every payload with its element figures, violations and what its screenshot shows; some have none or a broken one."""
    shots = I.redact_images(G.rasters(spark, sf_dir), G.fixed_boxes(spark, sf_dir, "blackout"), change=False)
    encoded = F.regexp_replace(F.base64("pam"), "[\r\n]", "")
    pages = grows(L.payload_compliance(spark, sf_dir)).join(
        I.to_pam(shots).select(F.col("image_id").alias("page_id"), encoded.alias("shot")), "page_id", "left"
    )
    k = F.col("page_id") % 6
    sent = pages.withColumn("shot", F.when(k == 0, "").when(k == 1, F.repeat(F.lit("abc"), F.lit(100))).otherwise(F.col("shot")))
    found = I.screenshot_stats(sent, "shot").drop("shot")
    return found.select(
        *[c for c in found.columns if c != "screenshot"], "screenshot.present", "screenshot.kb", "screenshot.width",
        F.round("screenshot.black_ratio", 4).alias("black_ratio"), F.col("screenshot.problem").isNotNull().alias("unreadable"),
    )

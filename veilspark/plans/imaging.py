"""Queries over images made from part keys (32 x 32 pixels each)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import geometry as G
from veilspark.functions import raster as R
from veilspark.operators import images as I
from veilspark.operators import tiles as L
from veilspark.operators.flow import run_step
from veilspark.plans.derived import form_elements, load
from veilspark.plans.registry import query
from veilspark.session import WORK_ROWS, grows, materialise, shared_dir, spread
from veilspark.sources import captures

SIDE = 32


def _painted(k: np.ndarray) -> np.ndarray:
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    k = k[:, None, None]
    img = np.empty((len(k), SIDE, SIDE, 4), dtype=np.uint8)
    img[..., 0], img[..., 1] = 20 + (x * 3 + k) % 30, 26 + (y * 5 + k) % 30
    img[..., 2], img[..., 3] = 40 + (x + y + k) % 30, 255
    x0, y0, side = 4 + k % 8, 4 + (k * 3) % 8, 12 + k % 8
    face = (k % 3 != 0) & (x >= x0) & (x < x0 + side) & (y >= y0) & (y < y0 + side)
    face |= (k % 5 == 0) & (x >= 27) & (y >= 27)
    skin = np.stack([232 - (x + y) % 16, 181 - x % 8, 140 - y % 8], axis=-1)
    img[..., :3] = np.where(face[..., None], skin, img[..., :3])
    return img


_CYCLE = 120  # the least common multiple of all divisors in ``_painted``


def raster_keys(spark, sf_dir) -> DataFrame:
    """The images of ``rasters`` without their pixels, which ``raster_pixels`` gives."""
    keys = spread(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id")), "image_id", rows=WORK_ROWS)
    return keys.select(F.col("image_id").cast("bigint").alias("image_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))


@cache
def _kinds() -> np.ndarray:
    return _painted(np.arange(_CYCLE)).reshape(_CYCLE, -1)


def raster_pixels(batch: pa.RecordBatch) -> pa.Array:
    return I.binary_rows(_kinds()[batch.column("image_id").to_numpy(zero_copy_only=False) % _CYCLE])


def rasters(spark, sf_dir) -> DataFrame:
    """One image per part: dark noise, a skin-coloured square for two keys of
    three, a small second patch for one key of five."""
    return I.loaded(raster_keys(spark, sf_dir), raster_pixels)


_PX = f"""px0 AS (
    SELECT p_partkey AS k, CAST(xs.x AS BIGINT) AS x, CAST(ys.y AS BIGINT) AS y FROM part, range({SIDE}) xs(x), range({SIDE}) ys(y)),
px1 AS (
    SELECT *, ((k % 3 <> 0 AND x >= 4 + k % 8 AND x < 4 + k % 8 + 12 + k % 8 AND y >= 4 + (k * 3) % 8 AND y < 4 + (k * 3) % 8 + 12 + k % 8)
               OR (k % 5 = 0 AND x >= 27 AND y >= 27)) AS f FROM px0),
px AS (
    SELECT k AS image_id, x, y, CASE WHEN f THEN 232 - (x + y) % 16 ELSE 20 + (x * 3 + k) % 30 END AS r,
           CASE WHEN f THEN 181 - x % 8 ELSE 26 + (y * 5 + k) % 30 END AS g,
           CASE WHEN f THEN 140 - y % 8 ELSE 40 + (x + y + k) % 30 END AS b FROM px1)"""
_CELLS = f"""cells AS (
    SELECT image_id, x // 4 AS gx, y // 4 AS gy FROM px
    WHERE x % 4 = 2 AND y % 4 = 2 AND 128 - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b BETWEEN 77 AND 127
      AND 128 + 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b BETWEEN 133 AND 177 AND r + g + b > {fixed.SKIN_MIN_SUM}),
grown AS (
    SELECT DISTINCT image_id, gx + dx AS gx, gy + dy AS gy FROM cells, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) c(dy)
    WHERE gx + dx BETWEEN 0 AND 7 AND gy + dy BETWEEN 0 AND 7)"""


def _mask_cells(grow: bool):
    def kernel(images):
        masks = R.cell_mask(images)
        at, ys, xs = np.nonzero(R.dilate(masks) if grow else masks)
        return at, np.stack([xs, ys], axis=1)

    return kernel


@query("skin_cells", f"WITH {_PX}, {_CELLS} SELECT image_id, gx, gy FROM cells")
def skin_cells(spark, sf_dir):
    return I.per_stack(rasters(spark, sf_dir), _mask_cells(False), "image_id bigint, gx bigint, gy bigint")


@query("dilate_mask", f"WITH {_PX}, {_CELLS} SELECT image_id, gx, gy FROM grown")
def dilate_mask(spark, sf_dir):
    return I.per_stack(rasters(spark, sf_dir), _mask_cells(True), "image_id bigint, gx bigint, gy bigint")


_FACES = """reach AS (
    SELECT image_id, gy * 8 + gx AS root, gx, gy FROM grown
    UNION SELECT r.image_id, r.root, n.gx, n.gy FROM reach r JOIN grown n ON n.image_id = r.image_id
        AND abs(n.gx - r.gx) + abs(n.gy - r.gy) = 1),
label AS (SELECT image_id, gx, gy, min(root) AS root FROM reach GROUP BY ALL),
comp AS (SELECT image_id, root, min(gx) AS x0, min(gy) AS y0, max(gx) AS x1, max(gy) AS y1, count(*) AS area FROM label GROUP BY ALL),
face AS (
    SELECT image_id, root, x0 * 4 AS x, y0 * 4 AS y, tw * 4 AS w, th * 4 AS h, least(0.92::DOUBLE, 0.5 + 0.42::DOUBLE * fill) AS confidence
    FROM (SELECT *, x1 - x0 + 1 AS tw, y1 - y0 + 1 AS th, area / ((x1 - x0 + 1) * (y1 - y0 + 1)) AS fill FROM comp)
    WHERE area >= 24 AND tw / th BETWEEN 0.45 AND 2.1 AND fill >= 0.3)"""


@query(
    "face_components",
    f"""WITH RECURSIVE {_PX}, {_CELLS}, {_FACES}
    SELECT image_id, x, y, w AS width, h AS height, round(confidence, 9) AS confidence FROM face""",
)
def face_components(spark, sf_dir):
    return I.faces(rasters(spark, sf_dir)).select(
        "image_id", "box.*", F.round("confidence", 9).alias("confidence")
    )


@query(
    "face_tiles",
    f"""WITH RECURSIVE {_PX}, {_CELLS}, {_FACES}
    SELECT image_id, x, y, w AS width, h AS height, round(confidence, 9) AS confidence FROM face""",
)
def face_tiles(spark, sf_dir):
    """The same regions out of images in tiles of 12 pixels."""
    found = L.face_candidates(L.cut(rasters(spark, sf_dir), 12))
    return found.select("image_id", "box.*", F.round("confidence", 9).alias("confidence"))


def fixed_boxes(spark, sf_dir, mode: str) -> DataFrame:
    """One box per image from its key."""
    k = F.col("p_partkey")
    b = G.box(2 + k % 9, 3 + k % 7, 14 + k % 6, 13 + k % 9)
    return load(spark, sf_dir, "part").select(
        k.alias("image_id"), F.lit(0).alias("grp"), b.alias("box"), F.lit(0.9).alias("confidence"),
        F.lit("name").alias("pii_type"), F.lit(mode).alias("mode"),
        F.when(F.lit(mode != "blackout"), 6).cast("int").alias("block"),
    )


_BOX = """bx AS (SELECT p_partkey AS image_id, 2 + p_partkey % 9 AS tx, 3 + p_partkey % 7 AS ty, 14 + p_partkey % 6 AS tw, 13 + p_partkey % 9 AS th FROM part),
inb AS (SELECT px.*, tx, ty, tw, th, x >= tx AND x < tx + tw AND y >= ty AND y < ty + th AS inside FROM px JOIN bx USING (image_id))"""
_DARK = "dark AS (SELECT image_id, x, y, tx, ty, tw, th, inside, CASE WHEN inside THEN 0 ELSE r END AS r, CASE WHEN inside THEN 0 ELSE g END AS g, CASE WHEN inside THEN 0 ELSE b END AS b FROM inb)"
_SIG = f"sum(r * ((y * {SIDE} + x) % 97 + 1)) AS sig_r, sum(g * ((y * {SIDE} + x) % 97 + 1)) AS sig_g, sum(b * ((y * {SIDE} + x) % 97 + 1)) AS sig_b"


def _signed(images: DataFrame, *keep: str) -> DataFrame:
    sig = I.per_stack(images, lambda a: (np.arange(len(a)), R.signatures(a)), "image_id bigint, sig_r bigint, sig_g bigint, sig_b bigint")
    return grows(images.select("image_id", *keep)).join(sig, "image_id") if keep else sig


@query("blackout", f"WITH {_PX}, {_BOX}, {_DARK} SELECT image_id, {_SIG} FROM dark GROUP BY image_id")
def blackout(spark, sf_dir):
    return _signed(I.redact_images(rasters(spark, sf_dir), fixed_boxes(spark, sf_dir, "blackout"), change=False))


@query(
    "pixelate",
    f"""WITH {_PX}, {_BOX},
    m AS (SELECT image_id, x, y, r, g, b, inside, CASE WHEN inside THEN (x - tx) // 6 ELSE -1 END AS cx, CASE WHEN inside THEN (y - ty) // 6 ELSE -1 END AS cy FROM inb),
    flat AS (SELECT image_id, x, y,
        CASE WHEN inside THEN floor(avg(r) OVER w + 0.5) ELSE r END AS r, CASE WHEN inside THEN floor(avg(g) OVER w + 0.5) ELSE g END AS g,
        CASE WHEN inside THEN floor(avg(b) OVER w + 0.5) ELSE b END AS b FROM m WINDOW w AS (PARTITION BY image_id, cx, cy))
    SELECT image_id, {_SIG} FROM flat GROUP BY image_id""",
)
def pixelate(spark, sf_dir):
    """Boxes pixelated, but not smeared."""
    return _signed(I.redact_images(rasters(spark, sf_dir), fixed_boxes(spark, sf_dir, "blur"), smear=False, change=False))


def _blur_sql() -> str:
    """Pixelated box, then two passes of the 3-wide mean, rows then columns."""
    ctes, src = [], "flat0"
    for p in (1, 2):
        ctes.append(
            f"row{p} AS (SELECT s.image_id, s.x, s.y, any_value(s.x0) AS x0, any_value(s.y0) AS y0, any_value(s.x1) AS x1, any_value(s.y1) AS y1, "
            + ", ".join(f"CAST(sum(CAST(n.{c} AS DOUBLE)) / 3 AS FLOAT) AS {c}" for c in "rgb")
            + f" FROM {src} s, (VALUES (-1), (0), (1)) d(d) JOIN {src} n ON n.image_id = s.image_id AND n.y = s.y "
            "AND n.x = greatest(s.x0, least(s.x1, s.x + d.d)) GROUP BY s.image_id, s.x, s.y)"
        )
        ctes.append(
            f"col{p} AS (SELECT s.image_id, s.x, s.y, any_value(s.x0) AS x0, any_value(s.y0) AS y0, any_value(s.x1) AS x1, any_value(s.y1) AS y1, "
            + ", ".join(f"floor(sum(CAST(n.{c} AS DOUBLE)) / 3 + 0.5) AS {c}" for c in "rgb")
            + f" FROM row{p} s, (VALUES (-1), (0), (1)) d(d) JOIN row{p} n ON n.image_id = s.image_id AND n.x = s.x "
            "AND n.y = greatest(s.y0, least(s.y1, s.y + d.d)) GROUP BY s.image_id, s.x, s.y)"
        )
        src = f"col{p}"
    return ",\n".join(ctes)


@query(
    "blur",
    f"""WITH {_PX}, {_BOX},
    flat0 AS (SELECT image_id, x, y, tx AS x0, ty AS y0, tx + tw - 1 AS x1, ty + th - 1 AS y1,
        floor(avg(r) OVER w + 0.5) AS r, floor(avg(g) OVER w + 0.5) AS g, floor(avg(b) OVER w + 0.5) AS b
        FROM inb WHERE inside WINDOW w AS (PARTITION BY image_id, (x - tx) // 6, (y - ty) // 6)),
    {_blur_sql()},
    done AS (SELECT image_id, x, y, r, g, b FROM inb WHERE NOT inside UNION ALL SELECT image_id, x, y, r, g, b FROM col2)
    SELECT image_id, {_SIG} FROM done GROUP BY image_id""",
)
def blur(spark, sf_dir):
    return _signed(I.redact_images(rasters(spark, sf_dir), fixed_boxes(spark, sf_dir, "blur"), change=False))


@query(
    "verify_blackout",
    f"""WITH {_PX}, {_BOX}, {_DARK},
    s AS (SELECT image_id, 'redacted' AS what, 0.299 * r + 0.587 * g + 0.114 * b AS l, x, y, tx, ty, tw, th FROM dark WHERE inside
          UNION ALL SELECT image_id, 'raw', 0.299 * r + 0.587 * g + 0.114 * b, x, y, tx, ty, tw, th FROM inb WHERE inside)
    SELECT image_id, what, avg(l) < 10 AND var_pop(l) < 8 AS ok FROM s
    WHERE (x - tx) % greatest(1, least(tw, th) // 8) = 0 AND (y - ty) % greatest(1, least(tw, th) // 8) = 0 GROUP BY image_id, what""",
)
def verify_blackout(spark, sf_dir):
    images, boxes = rasters(spark, sf_dir), fixed_boxes(spark, sf_dir, "blackout")
    redacted = I.redact_images(images, boxes, change=False).select("image_id", F.lit("redacted").alias("what"), F.col("verified").alias("ok"))
    raw = I.verify_images(images, boxes).select("image_id", F.lit("raw").alias("what"), F.col("verified").alias("ok"))
    return raw.unionByName(redacted)


@query(
    "black_ratio",
    f"""WITH {_PX}, {_BOX}, {_DARK},
    m AS (SELECT image_id, x // 8 AS cx, y // 8 AS cy, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM dark GROUP BY ALL)
    SELECT image_id, avg(CASE WHEN r < 12 AND g < 12 AND b < 12 THEN 1.0::DOUBLE ELSE 0 END) AS ratio FROM m GROUP BY image_id""",
)
def black_ratio(spark, sf_dir):
    done = I.redact_images(rasters(spark, sf_dir), fixed_boxes(spark, sf_dir, "blackout"), change=False, black=True)
    return done.select("image_id", F.col("black_share").alias("ratio"))


@query(
    "mutation_gate",
    f"""WITH {_PX}, {_BOX},
    m AS (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM inb WHERE inside
          GROUP BY image_id, (x - tx) * 16 // tw, (y - ty) * 16 // th)
    SELECT image_id, round(sum(r + g + b) / count(*), 6) AS change, sum(r + g + b) / count(*) >= 20 AS changed FROM m GROUP BY image_id""",
)
def mutation_gate(spark, sf_dir):
    done = I.redact_images(rasters(spark, sf_dir), fixed_boxes(spark, sf_dir, "blackout"))
    return done.select("image_id", F.round("least_change", 6).alias("change"), (F.col("least_change") >= 20).alias("changed"))


@query("apply_and_verify")
def apply_and_verify(spark, sf_dir):
    """Faces found, merged with a form box, destroyed and verified."""
    images = rasters(spark, sf_dir)
    found = I.faces(images).select("image_id", "pos", "box", "confidence", "pii_type", "mode")
    form = fixed_boxes(spark, sf_dir, "blackout").filter(F.col("image_id") % 4 == 0).select(
        "image_id", F.lit(1000).cast("long").alias("pos"), "box", "confidence", "pii_type", "mode"
    )
    applied = I.applied_boxes(images, found.unionByName(form))
    return I.redact_images(images, applied, black=True).drop("data")


@query(
    "image_round_trip",
    f"""SELECT p_partkey AS image_id, {4 * SIDE * SIDE} AS n_bytes, round_even(length(to_base64(repeat('x', {4 * SIDE * SIDE})::BLOB)) / 1024, 1) AS kb,
    true AS same FROM part""",
)
def image_round_trip(spark, sf_dir):
    """Raw bytes to a data URL and back."""
    url = I.to_data_url(rasters(spark, sf_dir), "data")
    back = I.from_data_url(url, "url", "copy")
    return back.select(
        "image_id",
        F.length("copy").alias("n_bytes"),
        F.bround(F.length(F.substring_index("url", ",", -1)) / 1024, 1).alias("kb"),
        (F.col("copy") == F.col("data")).alias("same"),
    )


@query(
    "stored_captures",
    f"""WITH {_PX}, sig AS (SELECT image_id, {_SIG} FROM (SELECT image_id, x, y, r, g, b FROM px WHERE image_id % 7 <> 0) GROUP BY image_id)
    SELECT CAST(p_partkey AS VARCHAR) AS capture_id, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 4 END AS elements,
        CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 > 0 THEN p_name END AS first_value, sig_r, sig_g, sig_b
    FROM part LEFT JOIN sig ON sig.image_id = p_partkey""",
)
def stored_captures(spark, sf_dir):
    """Captures written, written again and read: each once, with its elements and its image, or without."""
    captures.register(spark)
    k = F.col("p_partkey")
    one = F.struct(*[
        (F.lit("input") if f.name == "tag" else F.col("p_name") if f.name == "value" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in captures.ELEMENT.fields
    ])
    shots = rasters(spark, sf_dir).select(F.col("image_id").alias("p_partkey"), F.when(F.col("image_id") % 7 != 0, F.struct("width", "height", "data")).alias("image"))
    rows = load(spark, sf_dir, "part").join(grows(shots), "p_partkey").select(
        k.cast("string").alias("capture_id"), F.lit("s").alias("session_id"), (k % 8).cast("int").alias("step"),
        F.lit(None).cast("string").alias("url"), "p_name", "p_partkey", "image",
    ).select(
        "capture_id", "session_id", "step", "url", F.col("p_name").alias("title"),
        F.struct(F.lit(1280.0).alias("width"), F.lit(800.0).alias("height")).alias("viewport"),
        F.when(k % 5 != 0, F.array_repeat(one, (k % 4).cast("int"))).alias("elements"), "image",
    )
    folder = shared_dir(spark, "captures")
    for _ in range(2):
        rows.write.format("captures").mode("overwrite").save(folder)
    back = materialise(spark.read.format("captures").load(folder), "captures-read")
    images = back.where("image IS NOT NULL").select(F.col("capture_id").cast("bigint").alias("image_id"), "image.*")
    told = _signed(images).withColumn("capture_id", F.col("image_id").cast("string")).drop("image_id")
    elements = F.coalesce(F.nullif(F.size("elements"), F.lit(-1)), F.lit(0)).cast("long")
    return back.select("capture_id", elements.alias("elements"), F.get("elements", F.lit(0))["value"].alias("first_value")).join(grows(told), "capture_id", "left")


@query("protected_step")
def protected_step(spark, sf_dir):
    """The whole step for every form page, with the page's part image as capture."""
    elements = form_elements(spark, sf_dir)
    step = run_step(elements, raster_keys(spark, sf_dir), (1280.0, 800.0), F.lit("Fill the form"), raster_pixels)
    return step.verdicts.select("page_id", "detections", "boxes", "verified", "vault_leaks", "pattern_leaks", "status")

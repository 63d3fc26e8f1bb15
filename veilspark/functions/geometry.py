"""Box arithmetic as column expressions.  A box is struct<x,y,width,height: double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,width:double,height:double>"


def box(x, y, width, height) -> Column:
    names = ("x", "y", "width", "height")
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (x, y, width, height)]
    return F.struct(*[p.cast("double").alias(n) for p, n in zip(parts, names)])


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def round_half_up(v: Column, digits: int = 0) -> Column:
    scale = 10 ** digits
    rounded = F.floor(v * scale + 0.5)
    return rounded.cast("double") / scale if digits else rounded.cast("double")


def clamp(v: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.greatest(low, F.least(high, v))


def linear_score(v: Column, best: float, worst: float) -> Column:
    """1 at or below ``best``, 0 at or above ``worst``, linear in between."""
    return F.lit(1.0) - clamp((v - best) / (worst - best), 0.0, 1.0)


def clamp_box(b: Column, width, height) -> Column:
    x, y = clamp(b["x"], 0, width), clamp(b["y"], 0, height)
    x2, y2 = clamp(right(b), 0, width), clamp(bottom(b), 0, height)
    return box(x, y, F.greatest(F.lit(0.0), x2 - x), F.greatest(F.lit(0.0), y2 - y))


def expand_box(b: Column, pad: float, width, height) -> Column:
    grown = box(b["x"] - pad, b["y"] - pad, b["width"] + 2 * pad, b["height"] + 2 * pad)
    return clamp_box(grown, width, height)


def round_box(b: Column) -> Column:
    return box(*[round_half_up(b[n]) for n in ("x", "y", "width", "height")])


def scale_box(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x"] * sx, b["y"] * sy, b["width"] * sx, b["height"] * sy)


def overlap_area(a: Column, b: Column) -> Column:
    dx = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    dy = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), dx) * F.greatest(F.lit(0.0), dy)


def iou(a: Column, b: Column) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def containment(a: Column, b: Column) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller <= 0, F.lit(0.0)).otherwise(overlap_area(a, b) / smaller)


def union_box(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(right(a), right(b)) - x, F.greatest(bottom(a), bottom(b)) - y)


def union_box_agg(b: Column) -> Column:
    """Bounding box of a group; works as a partial aggregate."""
    x, y = F.min(b["x"]), F.min(b["y"])
    return box(x, y, F.max(right(b)) - x, F.max(bottom(b)) - y)

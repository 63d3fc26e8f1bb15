"""Order-dependent folds over the boxes of one page, of any number.

Each fold goes through the boxes in their order, and each box only has to look at boxes
that it overlaps. Those come from a grid of cells as large as a usual box; what covers very
many cells is looked at always. So ten thousand boxes on one page cost as many small
look-ups, not every pair. A box with a missing side overlaps nothing.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]
MANY_CELLS = 400
"""Cells that a box may cover before it counts as one that lies everywhere."""


def _overlap(a: Box, b: Box) -> float:
    dx = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    dy = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return max(0.0, dx) * max(0.0, dy)


def _iou(a: Box, b: Box) -> float:
    inter = _overlap(a, b)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return 0.0 if union <= 0 else inter / union


def _contained(a: Box, b: Box) -> float:
    smaller = min(a[2] * a[3], b[2] * b[3])
    return 0.0 if smaller <= 0 else _overlap(a, b) / smaller


def _union(a: Box, b: Box) -> Box:
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y


class _Grid:
    """Numbers of boxes by the cells that they cover."""

    def __init__(self, boxes: Iterable[Box]):
        real = [b for b in boxes if b is not None]
        self.sx = max(1.0, median(b[2] for b in real)) if real else 1.0
        self.sy = max(1.0, median(b[3] for b in real)) if real else 1.0
        self.cells: defaultdict[tuple[int, int], list[int]] = defaultdict(list)
        self.everywhere: list[int] = []
        self.all: list[int] = []

    def _covered(self, b: Box) -> list[tuple[int, int]] | None:
        spans = [(math.floor(lo / s), math.floor((lo + max(0.0, size)) / s)) for lo, size, s in ((b[0], b[2], self.sx), (b[1], b[3], self.sy))]
        (x0, x1), (y0, y1) = spans
        if (x1 - x0 + 1) * (y1 - y0 + 1) > MANY_CELLS:
            return None
        return [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]

    def add(self, i: int, b: Box) -> None:
        cells = self._covered(b)
        self.all.append(i)
        if cells is None:
            self.everywhere.append(i)
        for c in cells or ():
            self.cells[c].append(i)

    def near(self, b: Box) -> Iterator[int]:
        """At least all boxes that overlap ``b``, some more than once."""
        cells = self._covered(b)
        if cells is None:
            yield from self.all
            return
        yield from self.everywhere
        for c in cells:
            yield from self.cells.get(c, ())


def kept(boxes: list[Box | None], threshold: float) -> list[int]:
    """Numbers of the boxes that no box kept earlier overlaps with an IoU of ``threshold`` or more."""
    grid, out = _Grid(boxes), []
    for i, b in enumerate(boxes):
        if b is not None:
            others = grid.near(b) if threshold > 0 else grid.all
            if any(_iou(boxes[k], b) >= threshold for k in others):
                continue
            grid.add(i, b)
        out.append(i)
    return out


def groups(boxes: list[Box | None], min_iou: float, min_containment: float) -> list[list[int]]:
    """Each box joins the first group with a member that it overlaps enough, or begins one."""
    grid, out, group = _Grid(boxes), [], {}
    for i, b in enumerate(boxes):
        slot = None
        if b is not None:
            for m in grid.near(b):
                if (slot is None or group[m] < slot) and _overlap(boxes[m], b) > 0 and (
                        _iou(boxes[m], b) >= min_iou or _contained(boxes[m], b) >= min_containment):
                    slot = group[m]
                    if slot == 0:
                        break
            grid.add(i, b)
        if slot is None:
            slot = len(out)
            out.append([])
        out[slot].append(i)
        group[i] = slot
    return out


def grown(boxes: list[Box | None], threshold: float) -> list[Box | None]:
    """Each free box takes up the later ones that reach ``threshold`` against what it has grown to so far."""
    grid, free, out = _Grid(boxes), [True] * len(boxes), []
    for i, b in enumerate(boxes):
        if b is not None:
            grid.add(i, b)
    for i, b in enumerate(boxes):
        if not free[i]:
            continue
        if b is not None:
            seen = set(grid.near(b) if threshold > 0 else grid.all)
            waiting = [j for j in seen if j > i and free[j]]
            heapq.heapify(waiting)
            while waiting:
                j = heapq.heappop(waiting)
                if _iou(b, boxes[j]) >= threshold:
                    free[j] = False
                    larger = _union(b, boxes[j])
                    new = set(grid.near(larger)) - seen if larger != b else ()
                    b = larger
                    for k in new:  # a box that only the larger one meets
                        seen.add(k)
                        if k > j and free[k]:
                            heapq.heappush(waiting, k)
        out.append(b)
    return out


def _boxes(items: pa.ListArray):
    """The boxes of each list."""
    for items_of in items:
        yield None if not items_of.is_valid else [
            None if b is None or any(b[n] is None for n in ("x", "y", "width", "height")) else (b["x"], b["y"], b["width"], b["height"])
            for b in items_of.as_py()
        ]


def kept_at(boxes: Column, threshold: float) -> Column:
    """Of an array of boxes the numbers, from 1, of those that ``kept`` leaves."""
    @F.arrow_udf("array<int>")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [i + 1 for i in kept(x, threshold)] for x in _boxes(lists)], pa.list_(pa.int32()))

    return run(boxes)


def groups_at(boxes: Column, min_iou: float, min_containment: float) -> Column:
    """Numbers, from 1, of the members of each group."""
    @F.arrow_udf("array<array<int>>")
    def run(lists: pa.Array) -> pa.Array:
        found = [None if x is None else [[i + 1 for i in g] for g in groups(x, min_iou, min_containment)] for x in _boxes(lists)]
        return pa.array(found, pa.list_(pa.list_(pa.int32())))

    return run(boxes)


def grown_boxes(boxes: Column, threshold: float) -> Column:
    names = ("x", "y", "width", "height")

    @F.arrow_udf("array<struct<x:double,y:double,width:double,height:double>>")
    def run(lists: pa.Array) -> pa.Array:
        found = [None if x is None else [None if b is None else dict(zip(names, b, strict=True)) for b in grown(x, threshold)] for x in _boxes(lists)]
        return pa.array(found, pa.list_(pa.struct([(n, pa.float64()) for n in names])))

    return run(boxes)

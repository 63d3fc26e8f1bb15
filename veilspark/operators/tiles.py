"""Regions of images that come in tiles: no task ever holds the pixels of a whole image.

A tile is a rectangle of an image whose corner lies on the cell grid; the tiles of an image
cover it once. Each tile is read once, into the skin mask of its cells, one bit a cell, 512
times less than its pixels. The masks of an image of up to ``STITCH_CELLS`` cells are laid
together in one task, which finds the regions of many images at once. A larger image stays
cut: growing the mask by a cell may reach into the tiles around, so a tile also tells which
cells beyond its border it reaches. With those, each tile labels the regions inside it, and
regions that touch across a border are joined by grouped minima over several tasks. Sizes and
corners are sums and minima over the regions' parts. Both ways give the same regions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import geometry as G
from veilspark.functions import raster as R
from veilspark.operators.connected import roots
from veilspark.operators.images import binary_rows
from veilspark.session import materialise, ship_package

TILE = "image_id bigint, x int, y int, width int, height int, data binary"
"""x, y: place of the tile in its image; data: its raw RGBA pixels."""


STITCH_CELLS = 1 << 20
"""Cells of an image (16 million pixels, a mask of 128 KB) up to which its masks are laid together."""


def _sizes(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1).astype(np.int64)


def cut(images: DataFrame, side: int) -> DataFrame:
    """Tiles of at most ``side`` x ``side`` pixels (a multiple of the cell) out of whole images."""
    if side % fixed.CELL_PX:
        raise ValueError("a tile must be a multiple of the cell")
    ship_package(images.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column("image_id").to_numpy()
            for at, stack in R.stacks(_sizes(batch, "width", "height"), batch.column("data").to_pylist()):
                n, height, width = stack.shape[:3]
                for y in range(0, height, side):
                    for x in range(0, width, side):
                        part = stack[:, y:y + side, x:x + side]
                        place = [pa.array(np.full(n, v, dtype=np.int32)) for v in (x, y, part.shape[2], part.shape[1])]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), *place, binary_rows(part.reshape(n, -1))], names=_TILE)

    return images.select("image_id", "width", "height", "data").mapInArrow(run, TILE)


_TILE = [c.split()[0] for c in TILE.split(", ")]
_MASK = "image_id bigint, gx int, gy int, w int, h int, mask binary"


def _masks(tiles: DataFrame, cell: int) -> DataFrame:
    """image_id, gx, gy, w, h (of the tile in cells), mask (its bits).

    The last cell of an image may be cut; then its centre moves onto the last pixel, as in a whole image.
    """
    def run(batches):
        for batch in batches:
            ids, place = batch.column("image_id").to_numpy(), (_sizes(batch, "x", "y") // cell).astype(np.int32)
            for at, stack in R.stacks(_sizes(batch, "width", "height"), batch.column("data").to_pylist()):
                mask = R.cell_mask(stack, cell)
                size = [pa.array(np.full(len(at), v, dtype=np.int32)) for v in (mask.shape[2], mask.shape[1])]
                bits = np.packbits(mask.reshape(len(at), -1), axis=1)
                columns = [pa.array(ids[at]), *[pa.array(place[at, i]) for i in (0, 1)], *size, binary_rows(bits)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _MASK.split(", ")])

    return tiles.select(*_TILE).mapInArrow(run, _MASK)


_REGIONS = "image_id bigint, first bigint, x0 int, y0 int, x1 int, y1 int, area bigint, cells bigint"


def _stitched(masks: DataFrame) -> DataFrame:
    """The regions of images whose masks are laid together, each image by one task, a batch of images at a time."""
    packed = masks.groupBy("image_id").agg(F.collect_list(F.struct("gx", "gy", "w", "h", "mask")).alias("tiles"))

    def run(batches):
        for batch in batches:
            ids, lists = batch.column("image_id").to_numpy(), batch.column("tiles")
            image = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            tiles = lists.flatten()
            gx, gy, w, h = (tiles.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("gx", "gy", "w", "h"))
            bits = tiles.field("mask").to_pylist()
            wide, high = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            np.maximum.at(wide, image, gx + w)
            np.maximum.at(high, image, gy + h)
            begin = np.concatenate([[0], np.cumsum(wide * high)])
            plane = np.zeros(begin[-1], dtype=bool)
            for (tw, th), at in R.equal_rows(np.stack([w, h], axis=1)):
                own = np.frombuffer(b"".join([bits[i] for i in at]), np.uint8).reshape(len(at), -1)
                y, x = np.divmod(np.arange(tw * th), tw)
                to = image[at, None]
                plane[begin[to] + (gy[at, None] + y) * wide[to] + gx[at, None] + x] = np.unpackbits(own, axis=1, count=tw * th)
            for (iw, ih), at in R.equal_rows(np.stack([wide, high], axis=1)):
                stack = plane[begin[at, None] + np.arange(iw * ih)].reshape(len(at), ih, iw)
                parts = R.labelled_stack(R.dilate(stack))[0]
                columns = [pa.array(ids[at][parts[:, 0]]), pa.array((parts[:, 2] << 32) | parts[:, 1])]
                columns += [pa.array(parts[:, c].astype(np.int32)) for c in (3, 4, 5, 6)]
                columns += [pa.array(parts[:, 7]), pa.array(np.full(len(parts), iw * ih, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _REGIONS.split(", ")])

    return packed.mapInArrow(run, _REGIONS)


def _beyond(masks: DataFrame) -> DataFrame:
    """``masks`` with ``beyond``: the cells next to the tile that its mask reaches."""
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                grown = R.dilate(R.padded(_unpacked(row)))
                grown[1:-1, 1:-1] = False
                ys, xs = np.nonzero(grown)
                out.append([{"x": int(x), "y": int(y)} for x, y in zip(xs + row.gx - 1, ys + row.gy - 1, strict=True)])
            yield batch.assign(beyond=out)

    return masks.mapInPandas(run, _MASK + ", beyond array<struct<x:int,y:int>>")


def _unpacked(row) -> np.ndarray:
    return np.unpackbits(np.frombuffer(row.mask, np.uint8), count=row.w * row.h).reshape(row.h, row.w).astype(bool)


_PARTS = "image_id bigint, part bigint, x0 int, y0 int, x1 int, y1 int, area bigint, border array<struct<x:int,y:int>>"


def _labelled(masks: DataFrame) -> DataFrame:
    """image_id, part (a region inside a tile, numbered by its first cell), its corners, cells, and cells on the border."""
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                mask = R.dilate(_unpacked(row))
                for c in () if row.reached is None else row.reached:
                    mask[c["y"] - row.gy, c["x"] - row.gx] = True
                parts, cells, part = R.labelled_stack(mask[None])
                y, x = cells[:, 1], cells[:, 2]
                rim = (x == 0) | (x == row.w - 1) | (y == 0) | (y == row.h - 1)
                borders = [[] for _ in parts]
                for i, cy, cx in zip(part[rim].tolist(), y[rim].tolist(), x[rim].tolist(), strict=True):
                    borders[i].append({"x": cx + row.gx, "y": cy + row.gy})
                for (_, fx, fy, x0, y0, x1, y1, area), border in zip(parts.tolist(), borders, strict=True):
                    first = ((fy + row.gy) << 32) | (fx + row.gx)
                    out.append((row.image_id, first, x0 + row.gx, y0 + row.gy, x1 + row.gx, y1 + row.gy, area, border))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PARTS.replace("struct<x:int,y:int>", "s").split(", ")])

    return masks.mapInPandas(run, _PARTS)


def regions(tiles: DataFrame, cell: int = fixed.CELL_PX, stitch: int = STITCH_CELLS) -> DataFrame:
    """image_id, first (y and x of the region's first cell), x0, y0, x1, y1 (in cells), area, cells (of its image)."""
    ship_package(tiles.sparkSession)
    cells = F.sum(F.col("w").cast("long") * F.col("h")).over(Window.partitionBy("image_id"))
    masks = materialise(_masks(tiles, cell).withColumn("cells", cells), "tile-masks")
    small = _stitched(masks.where(F.col("cells") <= stitch))
    large = masks.where(F.col("cells") > stitch)
    return small.unionByName(_joined(_beyond(large.drop("cells")))) if large.head(1) else small


def _joined(masks: DataFrame) -> DataFrame:
    """The regions of images whose tiles stay apart."""
    masks = materialise(masks, "tile-borders")
    # A cell beyond one tile's border lies in the tile whose rectangle holds it: both meet by image and cell row band.
    reach = masks.select("image_id", F.explode("beyond").alias("c")).distinct()
    places = masks.select("image_id", "gx", "gy", "w", "h")
    bands = places.select("*", F.explode(F.sequence(F.col("gy"), F.col("gy") + F.col("h") - 1)).alias("band"))
    reached = (
        reach.select("image_id", "c", F.col("c.y").alias("band")).join(bands, ["image_id", "band"])
        .where((F.col("c.x") >= F.col("gx")) & (F.col("c.x") < F.col("gx") + F.col("w")))
        .groupBy("image_id", "gx", "gy").agg(F.collect_list("c").alias("reached"))  # at most a tile's border
    )
    parts = materialise(_labelled(masks.join(reached, ["image_id", "gx", "gy"], "left").drop("beyond")), "tile-parts")
    cells = parts.select("image_id", "part", F.explode("border").alias("c")).select("image_id", "part", "c.x", "c.y")
    sides = cells.select("*", F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))).alias("d"))
    ahead = sides.select("image_id", F.col("part").alias("a"), (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    touching = ahead.join(cells.withColumnRenamed("part", "b"), ["image_id", "x", "y"]).where("a <> b")
    node = lambda c: F.struct("image_id", F.col(c).alias("part"))
    found = roots(touching.select(node("a").alias("a"), node("b").alias("b")))
    whole = parts.withColumn("node", node("part")).join(found, "node", "left").withColumn("root", F.coalesce("root.part", "part"))
    sizes = places.groupBy("image_id").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("cells"))
    merged = whole.groupBy("image_id", "root").agg(
        F.min("part").alias("first"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.sum("area").alias("area"),
    )
    return merged.drop("root").join(sizes, "image_id")


def face_candidates(
    tiles: DataFrame, cell: int = fixed.CELL_PX, min_area_ratio: float = 0.0006, min_fill: float = 0.3, stitch: int = STITCH_CELLS
) -> DataFrame:
    """image_id, first, box, confidence of face-like skin regions, as ``raster.face_boxes`` finds them in a whole image."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    fill = F.col("area") / (w * h)
    least = F.greatest(F.lit(24), F.floor(F.col("cells") * min_area_ratio))
    found = regions(tiles, cell, stitch).where((F.col("area") >= least) & (w / h).between(0.45, 2.1) & (fill >= min_fill))
    box = G.box(F.col("x0") * cell, F.col("y0") * cell, w * cell, h * cell)
    return found.select("image_id", "first", box.alias("box"), F.least(F.lit(0.92), 0.5 + fill * 0.42).alias("confidence"))

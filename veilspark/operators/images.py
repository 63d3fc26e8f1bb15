"""Image jobs: one row per image, kernels in Arrow batches.

Image rows are large: Arrow batches into Python are bounded in bytes by
``spark.sql.execution.arrow.maxBytesPerBatch``, batches out of it by
``BATCH_BYTES``.  The per-image work never crosses rows, so pixels are shuffled
only where detections from another table are joined in, and not even there if the
images are references: with ``load``, which gives the pixels of a batch of images,
each kernel opens them itself, after the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import geometry as G
from veilspark.functions import raster as R
from veilspark.operators import boxes as B
from veilspark.operators import quality as K
from veilspark.session import grows, ship_package
from veilspark.sources.captures import pam, unpam

IMAGE = "image_id bigint, width int, height int, data binary"
FACES = f"image_id bigint, pos bigint, box {G.BOX}, confidence double, pii_type string, mode string, source string, tier string, failure string"
Detector = Callable[[object], list]
Load = Callable[[pa.RecordBatch], pa.Array]
"""The raw RGBA pixels (binary) of a batch of images without them: image_id, width, height and what else tells the place."""
BATCH_ROWS, BATCH_BYTES = 2048, 32 << 20
STACK_ROWS = 512
"""Images that a kernel takes at once."""


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield row


def _batched(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    buffer: list[tuple] = []
    held = 0
    for row in rows:
        buffer.append(row)
        held += sum(len(v) for v in row if isinstance(v, bytes))
        if len(buffer) >= BATCH_ROWS or held >= BATCH_BYTES:
            yield pd.DataFrame(buffer, columns=columns)
            buffer, held = [], 0
    if buffer:
        yield pd.DataFrame(buffer, columns=columns)


def binary_rows(table: np.ndarray) -> pa.Array:
    """The rows of a table of bytes as binary values."""
    offsets = np.arange(len(table) + 1, dtype=np.int32) * np.int32(table.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(table))])


def _stacked(batches: Iterator[pa.RecordBatch], load: Load | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Images of one size together: their ids, their pixels (n, height, width, 4) and their rows."""
    for whole in batches:
        for begin in range(0, whole.num_rows, STACK_ROWS):
            batch = whole.slice(begin, STACK_ROWS)
            sizes = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("width", "height")], axis=1)
            ids = batch.column("image_id").to_numpy(zero_copy_only=False)
            data = batch.column("data") if load is None else load(batch)
            for at, images in R.stacks(sizes, data.to_pylist()):
                yield ids[at], images, batch.take(pa.array(at))


def loaded(images: DataFrame, load: Load) -> DataFrame:
    """Images with their pixels, out of references to them."""
    ship_package(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, STACK_ROWS):
                batch = whole.slice(begin, STACK_ROWS)
                told = [batch.column(n) for n in ("image_id", "width", "height")]
                yield pa.RecordBatch.from_arrays([*told, load(batch)], names=["image_id", "width", "height", "data"])

    return images.mapInArrow(run, IMAGE)


def from_data_url(df: DataFrame, column: str, output: str = "data") -> DataFrame:
    """Bytes of a ``data:`` URL (or of bare base64)."""
    return df.withColumn(output, F.unbase64(F.substring_index(column, ",", -1)))


def to_pam(images: DataFrame, output: str = "pam") -> DataFrame:
    """``images`` with their pixels as a PAM image, which tells its size."""
    ship_package(images.sparkSession)

    @F.arrow_udf("binary")
    def run(width: pa.Array, height: pa.Array, data: pa.Array) -> pa.Array:
        rows = zip(width.to_pylist(), height.to_pylist(), data.to_pylist(), strict=True)
        return pa.array([None if d is None else pam(w, h, d) for w, h, d in rows], pa.binary())

    return images.withColumn(output, run("width", "height", "data"))


def to_data_url(df: DataFrame, column: str, mime: str = "image/jpeg", output: str = "url") -> DataFrame:
    encoded = F.regexp_replace(F.base64(column), "[\r\n]", "")
    return df.withColumn(output, F.concat(F.lit(f"data:{mime};base64,"), encoded))


def face_candidates(
    images: DataFrame,
    cell: int = fixed.CELL_PX,
    min_area_ratio: float = 0.0006,
    min_fill: float = 0.3,
    load_model: Callable[[], Detector] | None = None,
    load: Load | None = None,
) -> DataFrame:
    """Face boxes per image, before deduplication.

    ``load_model`` gives a detector (image array -> list of (x, y, w, h,
    confidence)); it runs once per task.  Without a model, when it finds
    nothing, or when it fails, the skin-region heuristic is used, ``tier``
    tells which one spoke, and ``failure`` what the model raised.
    """
    ship_package(images.sparkSession)
    if load and load_model:
        images, load = loaded(images, load), None
    columns = [c.split()[0] for c in FACES.replace(G.BOX, "box_t").split(", ")]

    def by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, images, _ in _stacked(batches, load):
            image, boxes, confidence = R.face_stack(images, cell, min_area_ratio, min_fill)
            pos = np.arange(len(image)) - np.searchsorted(image, image)
            box = pa.StructArray.from_arrays([pa.array(boxes[:, i].astype(np.float64)) for i in range(4)], names=["x", "y", "width", "height"])
            told = [pa.array([t] * len(image), pa.string()) for t in ("face", "blur", "vision", "heuristic", None)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[image]), pa.array(pos), box, pa.array(confidence), *told], names=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = unloaded = None
        try:
            model = load_model() if load_model else None
        except Exception as e:
            unloaded = f"{type(e).__name__}: {e}"

        def found():
            for row in _rows(batches):
                image = R.decode(row.data, row.width, row.height)
                boxes, tier, failure = [], "heuristic", unloaded
                if model is not None:
                    try:
                        boxes = list(model(image))
                    except Exception as e:
                        boxes, failure = [], f"{type(e).__name__}: {e}"
                    tier = "model" if boxes else tier
                boxes = boxes or R.face_boxes(image, cell, min_area_ratio, min_fill)
                source = "vision-model" if tier == "model" else "vision"
                for i, (x, y, w, h, confidence) in enumerate(boxes):
                    box = {"x": float(x), "y": float(y), "width": float(w), "height": float(h)}
                    yield row.image_id, i, box, float(confidence), "face", "blur", source, tier, failure

        yield from _batched(found(), columns)

    plain = images if load else images.select("image_id", "width", "height", "data")
    return plain.mapInPandas(run, FACES) if load_model else plain.mapInArrow(by_size, FACES)


def faces(images: DataFrame, threshold: float = fixed.DEDUPE_IOU, **options) -> DataFrame:
    """Face detections per image: candidates, then keep-first deduplication."""
    return B.deduped(face_candidates(images, **options), "image_id", threshold=threshold)


def applied_boxes(images: DataFrame, detections: DataFrame, pad: float = fixed.REDACTION_PAD, min_iou: float = fixed.MERGE_IOU) -> DataFrame:
    """Whole-pixel boxes to destroy: overlapping detections merged, padded, clamped."""
    groups = B.merged(detections, "image_id", min_iou=min_iou)
    sized = grows(groups).join(images.select("image_id", "width", "height"), "image_id")
    return B.redaction_boxes(sized, F.col("width").cast("double"), F.col("height").cast("double"), pad).drop("width", "height")


def _with_boxes(images: DataFrame, applied: DataFrame, load: Load | None = None) -> DataFrame:
    """Images with their boxes as one list; the boxes of one image are a natural unit."""
    b = F.col("box")
    packed = applied.groupBy("image_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "grp", b["x"].cast("int").alias("x"), b["y"].cast("int").alias("y"), b["width"].cast("int").alias("w"),
                    b["height"].cast("int").alias("h"), F.coalesce("mode", F.lit(fixed.DEFAULT_MODE)).alias("mode"),
                    "block", "pii_type",
                )
            )
        ).alias("boxes")
    )
    columns = images.columns if load else ["image_id", "width", "height", "data"]
    return grows(images).join(packed, "image_id", "left").select(*columns, "boxes")


def _pixels(images: np.ndarray) -> pa.Array:
    flat = images.reshape(len(images), -1)
    return binary_rows(flat) if flat.size < 1 << 31 else pa.array([i.tobytes() for i in images], pa.binary())


@dataclass
class _Boxes:
    """The boxes of a stack of images, each image's in their order."""

    image: np.ndarray
    turn: np.ndarray
    x: np.ndarray
    y: np.ndarray
    kinds: np.ndarray
    modes: list[str]
    n: int

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Boxes:
        lists = batch.column("boxes")
        lengths = np.array([n or 0 for n in lists.value_lengths().to_pylist()], dtype=np.int64)
        items = lists.flatten()
        x, y, w, h = (items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xywh")
        modes, mode = np.unique(np.array(items.field("mode").to_pylist(), dtype=object).astype(str), return_inverse=True)
        block = np.array([-1 if b is None else b for b in items.field("block").to_pylist()], dtype=np.int64)
        turn = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        image = np.repeat(np.arange(len(lengths)), lengths)
        return cls(image, turn, x, y, np.stack([mode.reshape(-1), block, w, h], axis=1), modes.tolist(), len(lengths))

    def alike(self, where: np.ndarray) -> Iterator[tuple[np.ndarray, str, int | None, int, int]]:
        """Boxes of one mode, block and size: their places, and what they have in common."""
        chosen = np.nonzero(where)[0]
        for (mode, block, w, h), at in R.equal_rows(self.kinds[chosen]):
            yield chosen[at], self.modes[mode], None if block < 0 else block, w, h

    def parts(self, images: np.ndarray, at: np.ndarray, w: int, h: int) -> tuple[np.ndarray, ...]:
        return R.parts(images, self.image[at], self.x[at], self.y[at], w, h)

    def destroy(self, images: np.ndarray, smear: bool) -> None:
        for turn in range(int(self.turn.max(initial=-1)) + 1):  # a later box of an image sees what an earlier one left
            for at, mode, block, w, h in self.alike(self.turn == turn):
                part = self.parts(images, at, w, h)
                images[part] = R.destroyed(images[part], mode, block, smear)

    def verdicts(self, images: np.ndarray, thresholds: dict) -> tuple[np.ndarray, np.ndarray]:
        """For each image: its boxes that are large enough to be checked, and whether all of them are destroyed."""
        checked, ok = np.zeros(self.n, dtype=np.int32), np.ones(self.n, dtype=bool)
        for at, mode, block, w, h in self.alike((self.kinds[:, 2] >= 2) & (self.kinds[:, 3] >= 2)):
            np.add.at(checked, self.image[at], 1)
            np.logical_and.at(ok, self.image[at], R.all_destroyed(images[self.parts(images, at, w, h)], mode, block, **thresholds))
        return checked, ok

    def least_change(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        least = np.full(self.n, np.inf)
        for at, _, _, w, h in self.alike(np.ones(len(self.x), dtype=bool)):
            part = self.parts(before, at, w, h)
            np.minimum.at(least, self.image[at], R.mutations(before[part], after[part]))
        return least

    def counts(self, black: bool) -> np.ndarray:
        dark = np.array([m == "blackout" for m in self.modes], dtype=bool)[self.kinds[:, 0]] if len(self.x) else np.zeros(0, dtype=bool)
        return np.bincount(self.image[dark == black], minlength=self.n).astype(np.int32)


def redact_images(images: DataFrame, applied: DataFrame, smear: bool = True, change: bool = True, black: bool = False, load: Load | None = None,
                  pixels: bool = True, **thresholds: float) -> DataFrame:
    """Images with every applied box destroyed, the boxes, and the verdict.

    The boxes of an image travel as one list; an image without boxes passes
    unchanged and is verified. ``smear`` blurs what was pixelated; ``thresholds``
    are those of ``raster.is_destroyed``; ``least_change`` and ``black_share`` are
    measured on request only, and null otherwise. Without ``pixels`` every image is
    redacted and checked all the same, and only the verdict leaves its task.
    """
    ship_package(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, before, batch in _stacked(batches, load):
            after, boxes = before.copy(), _Boxes.of(batch)
            boxes.destroy(after, smear)
            checked, ok = boxes.verdicts(after, thresholds)
            dark, blurred = boxes.counts(True), boxes.counts(False)
            least = boxes.least_change(before, after) if change else np.full(len(ok), np.inf)
            told = [dark + blurred, dark, blurred, checked, ok]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("image_id"), batch.column("width"), batch.column("height"), *([_pixels(after)] if pixels else []),
                    *[pa.array(t) for t in told], pa.array(least, mask=np.isinf(least)),
                    pa.array(R.black_shares(after)) if black else pa.nulls(len(ok), pa.float64()),
                ],
                names=[c.split()[0] for c in out.split(", ")],
            )

    out = (
        f"image_id bigint, width int, height int, {'data binary, ' if pixels else ''}boxes int, blackouts int, blurs int, checked int, "
        "verified boolean, least_change double, black_share double"
    )
    return _with_boxes(images, applied, load).mapInArrow(run, out)


def verify_images(images: DataFrame, applied: DataFrame, **thresholds: float) -> DataFrame:
    """image_id, checked, verified: are the applied boxes of these images destroyed?"""
    ship_package(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pixels, batch in _stacked(batches):
            told = [pa.array(t) for t in _Boxes.of(batch).verdicts(pixels, thresholds)]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), *told], names=["image_id", "checked", "verified"])

    return _with_boxes(images, applied).mapInArrow(run, "image_id bigint, checked int, verified boolean")


_SHOT = "struct<width:int,height:int,black_ratio:double,problem:string>"


def screenshot_stats(payloads: DataFrame, encoded: str, output: str = "screenshot") -> DataFrame:
    """``payloads`` with a struct about the base64 PAM image in ``encoded``: present, kb (of the text), width, height,
    black_ratio (share of near-black pixels at an eighth of the size), problem (why there are no such figures)."""
    ship_package(payloads.sparkSession)

    @F.arrow_udf(_SHOT)
    def look(column: pa.Array) -> pa.Array:
        out = []
        for raw in column:
            found = {"width": None, "height": None, "black_ratio": None, "problem": None}
            if raw.is_valid:
                try:
                    width, height, data = unpam(raw.as_py())
                    share = R.black_share(R.decode(data, width, height)) if min(width, height) >= 8 else None
                    found |= {"width": width, "height": height, "black_ratio": share}
                except (ValueError, KeyError) as e:  # best effort, as the verdict does not rest on it
                    found["problem"] = type(e).__name__
            out.append(found)
        return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("black_ratio", pa.float64()), ("problem", pa.string())]))

    present = K.has_screenshot(F.col(encoded))
    looked = payloads.withColumn("_look", look(F.when(present, F.try_to_binary(F.col(encoded), F.lit("base64")))))
    fields = F.struct(
        present.alias("present"), K.kilobytes(F.col(encoded)).alias("kb"), *[F.col(f"_look.{c}").alias(c) for c in ("width", "height", "black_ratio")],
        F.when(present, F.coalesce("_look.problem", F.when(F.col("_look.width").isNull(), F.lit("not base64")))).alias("problem"),
    )
    return looked.withColumn(output, fields).drop("_look")


def per_image(images: DataFrame, kernel: Callable[[object], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``kernel(image array)`` prefixed with the image id."""
    ship_package(images.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (
            (row.image_id, *values) for row in _rows(batches) for values in kernel(R.decode(row.data, row.width, row.height))
        )
        yield from _batched(rows, names)

    return images.select("image_id", "width", "height", "data").mapInPandas(run, schema)


def per_stack(images: DataFrame, kernel: Callable[[object], tuple], schema: str) -> DataFrame:
    """Rows of ``kernel(images of one size)``: the place of each row's image in the stack, and a table of whole numbers."""
    ship_package(images.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, pixels, _ in _stacked(batches):
            at, table = kernel(pixels)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), *[pa.array(c.astype(np.int64)) for c in table.T]], names=names)

    return images.select("image_id", "width", "height", "data").mapInArrow(run, schema)

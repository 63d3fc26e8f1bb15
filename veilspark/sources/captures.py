"""Captured pages with their screenshots as a Spark data source, and a writer that puts both down once.

``spark.read.format("captures").load(folder)`` gives one row per capture, with or without
elements; ``df.write.format("captures").mode("overwrite").save(folder)`` stores such rows.
(Call ``register(spark)`` first.)

A task writes two files under names of its own: records as JSON lines, and images one after
the other in the PAM format, whose header tells their size. Only the files that the commit
message of a successful task names are listed in the manifest, which is put down last, in one
step. A task that runs twice, or dies, leaves files that no manifest names, so every capture
and its image are read exactly once; a reader never sees half a write. ``append`` adds to the
files of the manifest, ``overwrite`` replaces them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from veilspark.session import ship_package

_TEXTS = ("tag", "type", "id", "name", "selector", "text", "label", "placeholder", "aria_label", "autocomplete", "role", "value", "img_hints", "alt")
_SIDES = ("x", "y", "width", "height")
_RECT = T.StructType([T.StructField(n, T.DoubleType()) for n in _SIDES])
ELEMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXTS]
    + [T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("is_img", T.BooleanType()), T.StructField("visible", T.BooleanType()),
       T.StructField("rect", _RECT)]
)
SCHEMA = T.StructType([
    T.StructField("capture_id", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("step", T.IntegerType()),
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("viewport", T.StructType([T.StructField(n, T.DoubleType()) for n in ("width", "height")])),
    T.StructField("elements", T.ArrayType(ELEMENT)),
    T.StructField("image", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("data", T.BinaryType())])),
])
MANIFEST = "_captures.json"


def _folder(path: str):
    """Arrow's file system for a path, and the path inside it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside.rstrip("/")


def pam(width: int, height: int, data: bytes) -> bytes:
    """Raw RGBA pixels as a PAM image."""
    if len(data) != 4 * width * height:
        raise ValueError(f"an image of {width} x {height} has {4 * width * height} bytes, not {len(data)}")
    return b"P7\nWIDTH %d\nHEIGHT %d\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" % (width, height) + data


def unpam(raw: bytes) -> tuple[int, int, bytes]:
    head, _, data = raw.partition(b"ENDHDR\n")
    fields = dict(line.split(b" ", 1) for line in head.split(b"\n")[1:] if b" " in line)
    width, height = int(fields[b"WIDTH"]), int(fields[b"HEIGHT"])
    if not head.startswith(b"P7") or fields[b"DEPTH"] != b"4" or len(data) != 4 * width * height:
        raise ValueError("not a PAM image of RGBA pixels, or a cut one")
    return width, height, data


def _listed(system, inside: str) -> list[dict]:
    from pyarrow import fs

    place = f"{inside}/{MANIFEST}"
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(place) as f:
        return json.loads(f.read())


@dataclass
class _Files(InputPartition):
    records: str
    images: str


@dataclass
class _Written(WriterCommitMessage):
    records: str
    images: str
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Files(x["records"], x["images"]) for x in _listed(*_folder(self.path))] or [_Files("", "")]

    def read(self, partition: _Files) -> Iterator[tuple]:
        if not partition.records:
            return
        system, inside = _folder(self.path)
        with system.open_input_stream(f"{inside}/{partition.records}") as lines, system.open_input_file(f"{inside}/{partition.images}") as images:
            for line in _lines(lines):
                record = json.loads(line)
                at, size = record.pop("image_at"), record.pop("image_size")
                image = None
                if at is not None:
                    images.seek(at)
                    image = unpam(images.read(size))
                view = record["viewport"]
                yield (
                    record["capture_id"], record["session_id"], record["step"], record["url"], record["title"],
                    None if view is None else tuple(view), None if record["elements"] is None else [_element(e) for e in record["elements"]], image,
                )


def _element(values: list) -> tuple | None:
    if values is None:
        return None
    *texts, classes, is_img, visible, rect = values
    return (*texts, classes, is_img, visible, None if rect is None else tuple(rect))


def _lines(stream) -> Iterator[bytes]:
    """Lines of a stream, of any length, a block at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, inside = _folder(self.path)
        system.create_dir(inside, recursive=True)
        name, rows, at = uuid.uuid4().hex, 0, 0
        with system.open_output_stream(f"{inside}/{name}.jsonl") as lines, system.open_output_stream(f"{inside}/{name}.pam") as images:
            for row in iterator:
                record = row.asDict()
                image, place, size = record.pop("image"), None, None
                if image is not None and image["data"] is not None:
                    raw = pam(image["width"], image["height"], bytes(image["data"]))
                    images.write(raw)
                    place, size, at = at, len(raw), at + len(raw)
                record |= {"image_at": place, "image_size": size}
                lines.write(json.dumps(record).encode() + b"\n")  # a row inside is written as the list of its values
                rows += 1
        return _Written(f"{name}.jsonl", f"{name}.pam", rows)

    def commit(self, messages: list[_Written | None]) -> None:
        system, inside = _folder(self.path)
        system.create_dir(inside, recursive=True)
        old = _listed(system, inside)
        new = [{"records": m.records, "images": m.images, "rows": m.rows} for m in messages if m is not None and m.rows]
        draft = f"{inside}/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        system.move(draft, f"{inside}/{MANIFEST}")
        dropped = [m for m in messages if m is not None and not m.rows]
        self._remove(system, inside, [(x["records"], x["images"]) for x in (old if self.overwrite else [])] + [(m.records, m.images) for m in dropped])

    def abort(self, messages: list[_Written | None]) -> None:
        system, inside = _folder(self.path)
        self._remove(system, inside, [(m.records, m.images) for m in messages if m is not None])

    @staticmethod
    def _remove(system, inside: str, pairs: list[tuple[str, str]]) -> None:
        for pair in pairs:
            for name in pair:
                try:
                    system.delete_file(f"{inside}/{name}")
                except FileNotFoundError:
                    pass


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != SCHEMA.names:
            raise ValueError(f"captures have the columns {SCHEMA.names}")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(CaptureSource)

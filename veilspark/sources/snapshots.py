"""Element snapshots and ground truth as nested JSON, images as files, tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import geometry as G

_RECT = G.BOX
_ELEMENT = (
    "struct<tag:string,type:string,id:string,name:string,classes:array<string>,selector:string,text:string,"
    "label:string,placeholder:string,ariaLabel:string,autocomplete:string,role:string,value:string,isImg:boolean,"
    f"imgHints:string,alt:string,visible:boolean,rect:{_RECT}"
)
_VIEWPORT = "struct<width:double,height:double,dpr:double,scrollX:double,scrollY:double>"
SNAPSHOT = f"url string, title string, viewport {_VIEWPORT}, elements array<{_ELEMENT}>>"
GROUND_TRUTH = (
    "page string, title string, layout struct<width:double,height:double>, "
    f"elements array<{_ELEMENT},sensitive:boolean,piiType:string,mode:string,hint:string>>, "
    f"faces array<struct<box:{_RECT}>>"
)
_VERDICT = ("sensitive", "piiType", "mode", "hint")
_NAMES = {"ariaLabel": "aria_label", "isImg": "is_img", "imgHints": "img_hints"}


def below(file: Column, root: str) -> Column:
    """Path of a file below ``root``, or its name if ``root`` is the file or a pattern."""
    base = re.sub("^[a-z0-9+.-]+:/*", "/", root).rstrip("/") + "/"
    at = F.instr(file, base)
    return F.when(at > 0, F.substr(file, at + len(base))).otherwise(F.regexp_extract(file, r"([^/]+)$", 1))


def _exploded(pages: DataFrame, *keep: str) -> DataFrame:
    rows = pages.select(*keep, F.posexplode("elements").alias("pos", "_e")).select(*keep, "pos", "_e.*")
    for old, new in _NAMES.items():
        rows = rows.withColumnRenamed(old, new)
    return rows.withColumn("is_img", F.coalesce("is_img", F.lit(False)))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Element rows of snapshot files; the schema is declared, never inferred.

    ``page_id`` is the file's path below ``path`` without its ending, so files of
    one name in several folders are several pages.
    """
    raw = spark.read.schema(SNAPSHOT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    pages = raw.withColumn("page_id", F.regexp_replace(below(F.input_file_name(), path), r"\.json$", ""))
    return _exploded(pages, "page_id", "url", "title", "viewport")


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detector input, judged elements, faces).

    The detector input has no verdict columns and no ``span`` rows.
    """
    raw = spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path).withColumnRenamed("page", "page_id")
    judged = _exploded(raw, "page_id")
    faces = raw.select("page_id", F.posexplode("faces").alias("face_id", "_f")).select("page_id", "face_id", "_f.box")
    return judged.filter(F.col("tag") != "span").drop(*_VERDICT), judged, faces


def read_raw_images(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Raw RGBA files of one size as image rows, keyed by their path below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        below(F.col("path"), path).alias("name"),
        F.lit(width).alias("width"), F.lit(height).alias("height"), F.col("content").alias("data"),
    ).withColumn("image_id", F.xxhash64("name"))

import json
import os

import pytest
from pyspark.sql import functions as F

from veilspark.session import shared_dir
from veilspark.sources import captures as C

ELEMENT = {"tag": "input", "id": "é\"\n", "value": "x" * 50_000, "classes": ["a", None], "is_img": False, "visible": True, "rect": (1.0, 2.0, 3.5, None)}


def _element(**values):
    return tuple(values.get(n) for n in C.ELEMENT.names)


def _captures(spark, ids):
    rows = []
    for i in ids:
        elements = None if i % 5 == 0 else [] if i % 5 == 1 else [_element(**ELEMENT), None, _element(tag="a")]
        image = None if i % 3 == 0 else (2, i % 4, bytes(range(8 * (i % 4))))
        rows.append((str(i), None if i % 7 == 0 else "s", i, "u", None, None if i % 4 == 0 else (1280.0, 800.0), elements, image))
    return spark.createDataFrame(rows, C.SCHEMA)


@pytest.fixture
def folder(spark):
    C.register(spark)
    return shared_dir(spark, "captures")


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_round_trip_of_all_rows(spark, folder):
    want = _captures(spark, range(40)).repartition(4)
    want.write.format("captures").mode("overwrite").save(folder)
    assert _same(spark.read.format("captures").load(folder), want)


def test_written_again_and_appended(spark, folder):
    for _ in range(2):
        _captures(spark, range(10)).write.format("captures").mode("overwrite").save(folder)
    assert spark.read.format("captures").load(folder).count() == 10
    _captures(spark, range(10, 15)).write.format("captures").mode("append").save(folder)
    got = spark.read.format("captures").load(folder)
    assert _same(got, _captures(spark, range(15)))
    named = {x for e in json.load(open(f"{folder.removeprefix('file:')}/{C.MANIFEST}")) for x in (e["records"], e["images"])}
    assert {f for f in os.listdir(folder.removeprefix("file:")) if not f.startswith((".", "_"))} == named


def test_a_failed_write_leaves_what_was_there(spark, folder):
    _captures(spark, range(4)).write.format("captures").mode("overwrite").save(folder)
    cut = F.when(F.col("capture_id") == "8", F.struct(F.lit(9).alias("width"), F.lit(9).alias("height"), F.lit(b"x").alias("data"))).otherwise(F.col("image"))
    with pytest.raises(Exception, match="bytes"):
        _captures(spark, range(4, 12)).withColumn("image", cut.cast(C.SCHEMA["image"].dataType)).write.format("captures").mode("overwrite").save(folder)
    assert _same(spark.read.format("captures").load(folder), _captures(spark, range(4)))


def test_stray_files_are_not_read(spark, folder):
    _captures(spark, range(3)).write.format("captures").mode("overwrite").save(folder)
    with open(f"{folder.removeprefix('file:')}/stray.jsonl", "w") as f:
        f.write("not a record\n")
    assert spark.read.format("captures").load(folder).count() == 3


def test_nothing_written(spark, folder):
    assert spark.read.format("captures").load(folder).count() == 0
    _captures(spark, []).write.format("captures").mode("overwrite").save(folder)
    assert spark.read.format("captures").load(folder).count() == 0


def test_sizes_come_from_the_file():
    assert C.unpam(C.pam(3, 2, bytes(24))) == (3, 2, bytes(24))
    for bad in (b"P6\n", C.pam(3, 2, bytes(24))[:-1]):
        with pytest.raises((ValueError, KeyError)):
            C.unpam(bad)

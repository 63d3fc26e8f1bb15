"""Joins that grow with the input never pass through the driver, and narrow tables are dealt to all cores."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from veilspark import session
from veilspark.operators import elements as E
from veilspark.operators import images as I
from veilspark.operators import matching as M
from veilspark.plans import derived as D


LARGER = SF.replace("sf0.001", "sf0.01")  # 1,500 customers, enough for six tasks


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def unset(spark):
    """A session without the setting that deals small tables out, as a cluster's is."""
    before = spark.conf.get(session.SPREAD)
    spark.conf.unset(session.SPREAD)
    yield spark
    spark.conf.set(session.SPREAD, before)


@pytest.mark.parametrize("name", ["redaction_regions", "face_match", "key_set_ops", "stored_captures", "action_targets"])
def test_no_join_of_pages_or_images_is_broadcast(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "SortMergeJoin" in text
    # the fixed rows of the form templates and of the part of a page's label are all that may be
    assert text.count("BroadcastHashJoin") <= text.count("LocalTableScan")


def test_pixels_are_not_broadcast(spark):
    images = spark.createDataFrame([(1, 1, 1, b"abcd")], I.IMAGE)
    boxes = images.select(
        "image_id", F.lit(0).alias("grp"), F.expr("named_struct('x', 0d, 'y', 0d, 'width', 1d, 'height', 1d)").alias("box"),
        F.lit("blackout").alias("mode"), F.lit(None).cast("int").alias("block"), F.lit("name").alias("pii_type"),
    )
    assert "BroadcastHashJoin" not in plan(I.redact_images(images, boxes))


def test_whole_match_of_small_and_hinted_sides(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b")], "page_id int, selector string")
    r = spark.createDataFrame([(1, "b"), (2, "c")], "page_id int, selector string")
    rows = sorted(map(tuple, M.set_match(e, r, ["page_id"], "selector").collect()))
    assert rows == [(1, "a", True, False), (1, "b", True, True), (2, "c", False, True)]


def test_keys_are_dealt_by_their_number(unset):
    keys = unset.range(45_000).repartition(1)
    dealt = session.spread(keys, "id", rows=10_000)
    assert dealt.rdd.getNumPartitions() >= 5
    assert dealt.agg(F.sum("id")).first()[0] == sum(range(45_000))
    assert session.spread(unset.range(0), "id", rows=10_000).rdd.getNumPartitions() == 1
    assert session.spread(keys, "id").rdd.getNumPartitions() == 1  # wide tables have their file splits


@pytest.mark.parametrize("name", ["classify_elements", "mode_lookup", "scan_stats", "server_field_kind"])
def test_rules_are_compiled_by_the_jvm(spark, name):
    """It interprets methods above 8,000 bytes, which took more than half of the time of these queries."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    out = io.StringIO()
    try:
        with contextlib.redirect_stdout(out):
            entry.queries()[name](spark, SF).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000


def test_context_joins_the_filled_columns(spark):
    rows = spark.createDataFrame(
        [("a", None, ["x", "y"], "b"), ("", "c", [], None), (None, "", None, "")], "id string, name string, classes array<string>, label string"
    )
    assert [r[0] for r in rows.select(E.joined("id", "name", "classes", "label")).collect()] == ["a x y b", "c", ""]


def test_form_pages_are_dealt_to_several_tasks(unset):
    """All customers come in one file split, and one task made and matched the elements of all pages."""
    assert D.form_elements(unset, LARGER).rdd.getNumPartitions() >= min(4, unset.sparkContext.defaultParallelism)


def test_look_ups_of_targets_stay_in_the_tasks_of_their_pages(unset):
    """They met in shuffles of the session's own number of partitions, so with few of these a task's memory grew with the table."""
    before = unset.conf.get("spark.sql.shuffle.partitions")
    unset.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        text = plan(entry.queries()["action_targets"](unset, LARGER))
    finally:
        unset.conf.set("spark.sql.shuffle.partitions", before)
    dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", text)]
    wanted = session.tasks(D.load(unset, LARGER, "customer"), session.WORK_ROWS)
    assert wanted > 2 and set(dealt) == {wanted}
    assert "_rank" not in " ".join(re.findall(r"Exchange hashpartitioning\(.*?\)", text))


def test_actions_are_made_before_their_page_is_gathered(spark):
    """What stands inside an aggregate or a lambda is interpreted: the patterns of the fields, and the names of the whole
    page, made once for each of its fields."""
    text = plan(entry.queries()["action_plan"](spark, SF))
    gathered = [line for line in text.splitlines() if "Aggregate(" in line]
    assert gathered and not any("RLIKE" in line or "Contains(" in line for line in gathered)
    assert "array_position(transform(" not in text
    assert text.count("lower(coalesce(autocomplete") <= 1  # made once an element and not once a rule
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", codegen(spark, "action_plan")))) < 8000


def codegen(spark, name) -> str:
    before, out = spark.conf.get("spark.sql.adaptive.enabled"), io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(out):
            entry.queries()[name](spark, SF).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return out.getvalue()

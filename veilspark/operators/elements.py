"""Element tables: visibility, context, labels, page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed


def filled(name: str | Column) -> Column:
    """NULL for NULL and for the empty string."""
    return F.nullif(F.col(name) if isinstance(name, str) else name, F.lit(""))


def joined(*names: str) -> Column:
    """Filled columns, joined by blanks.

    The filter over an array also ends the code that Spark fuses for the steps before it. Fused with the making of the
    elements, the rules over a context came to a method above 8,000 bytes, which the JVM interprets for ever.
    """
    parts = [F.array_join(n, " ") if n == "classes" else F.col(n) for n in names]
    return F.array_join(F.filter(F.array(*parts), lambda part: part != ""), " ")


def strip_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#][\s\S]*$", "")


def class_list(class_attr: Column) -> Column:
    parts = F.filter(F.split(class_attr, r"\s+"), lambda c: c != "")
    return F.slice(F.coalesce(parts, F.array().cast("array<string>")), 1, fixed.CLASS_CAP)


def visible_from_markup(attr_hidden: Column, aria_hidden: Column, style: Column, width: Column, height: Column) -> Column:
    """Static visibility: attributes, inline style, and size where it is known."""
    css = F.lower(F.regexp_replace(F.coalesce(style, F.lit("")), r"\s+", ""))
    return ~(
        attr_hidden
        | (F.coalesce(aria_hidden, F.lit("")) == "true")
        | (F.coalesce(width, F.lit(2.0)) < 2)
        | (F.coalesce(height, F.lit(2.0)) < 2)
        | F.rlike(css, F.lit(r"(^|;)(display:none|visibility:hidden|opacity:0*\.?0*(;|$))"))
    )


def on_all_pages(elements: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """``elements`` and, for each page of ``pages`` that has none, one row with nothing but the page's keys, so that
    plans, summaries and payloads have a row for it too."""
    return pages.select(*keys).distinct().join(elements, list(keys), "left")


def is_interactive() -> Column:
    return F.coalesce(F.col("tag").isin(*fixed.INTERACTIVE_TAGS), F.lit(False)) | F.coalesce(
        F.col("role").isin(*fixed.INTERACTIVE_ROLES), F.lit(False)
    )


def is_on_screen(include_invisible: bool = False) -> Column:
    if include_invisible:
        return F.lit(True)
    # Only a known box hides an element; markup alone often gives none.
    sized = (F.col("rect.width") >= 2) & (F.col("rect.height") >= 2)
    return F.coalesce(F.col("visible"), F.lit(True)) & F.coalesce(sized, F.lit(True))


def interactive_context(elements: DataFrame, *keys: str, include_invisible: bool = False) -> DataFrame:
    """What a page reports about its controls; never a value."""
    def side(n: str) -> Column:
        return F.coalesce(F.col(f"rect.{n}"), F.lit(0.0)).alias(n)

    return elements.filter(is_on_screen(include_invisible) & is_interactive()).select(
        *keys,
        "pos",
        "tag",
        filled("type").alias("type"),
        "selector",
        F.coalesce(filled("label"), filled("placeholder"), filled("text")).alias("label"),
        filled(F.substring("text", 1, fixed.TEXT_CHARS)).alias("text"),
        filled("role").alias("role"),
        F.struct(*[side(n) for n in ("x", "y", "width", "height")]).alias("rect"),
    )


def scan_stats(elements: DataFrame, *keys: str) -> DataFrame:
    """Elements scanned, controls and detections per page; ``det`` must be present."""
    return elements.groupBy(*keys).agg(
        F.count("*").alias("scanned"),
        F.count_if(is_on_screen() & is_interactive()).alias("interactive"),
        F.count_if(F.col("det").isNotNull()).alias("pii"),
    )


def resolve_labels(fields: DataFrame, labels: DataFrame, *page: str) -> DataFrame:
    """Label of a field: first associated label, enclosing label, aria-label,
    placeholder, name.

    ``labels`` has (page, for_id, pos, text).  Only the first associated label
    counts; an empty one falls through to the next source.
    """
    def cut(c: Column) -> Column:
        return F.substring(c, 1, fixed.LABEL_CHARS)

    first = labels.groupBy(*page, F.col("for_id").alias("id")).agg(
        F.min_by(F.trim("text"), "pos").alias("_associated")
    )
    return (
        fields.join(first, [*page, "id"], "left")
        .withColumn(
            "resolved_label",
            F.coalesce(
                cut(filled("_associated")),
                cut(filled(F.trim("enclosing_label"))),
                cut(filled("aria_label")),
                cut(filled("placeholder")),
                filled("name"),
            ),
        )
        .drop("_associated")
    )


def capped(elements: DataFrame, *page: str, limit: int = fixed.ELEMENT_CAP) -> DataFrame:
    """First ``limit`` elements of each page in document order.

    ``pos`` is the document position (0-based and dense within a page), so the
    cap is a plain filter: no sort, no shuffle.
    """
    return elements.filter(F.col("pos") < limit)

"""Element rows out of raw HTML.

Layout is not known without a browser: the box of an element comes from pixel
values of its inline style, and an element without them has no box.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import geometry as G
from veilspark.operators import elements as E
from veilspark.session import ship_package
from veilspark.sources import markup

_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^'">]++)*+"""
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


_NUMERIC = r"&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"


def _character(entity: Column) -> Column:
    """The character of a numeric reference; '' for one that is no character."""
    digits = F.regexp_extract(entity, "([0-9A-Fa-f]+);", 1)
    code = F.when(F.lower(F.substring(entity, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    # UTF-32 bytes of the code, decoded.
    return F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF),
                  F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")


def _numeric(c: Column) -> Column:
    """Text with numeric character references replaced."""
    parts = F.split(c, f"(?={_NUMERIC})|(?<=;)")
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(f"^{_NUMERIC}$")), _character(p)).otherwise(p)), "")


def unescape(c: Column) -> Column:
    """Text with the common named references and all numeric ones replaced."""
    c = F.when(F.rlike(c, F.lit(_NUMERIC)), _numeric(c)).otherwise(c)
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def plain_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, "<[^>]*>", "")), r"\s+", " "))


def page_title(html: Column) -> Column:
    return F.substring(plain_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, fixed.TITLE_CHARS)


def _px(style: Column, name: str) -> Column:
    found = F.regexp_extract(style, rf"(?i)(?:^|[;\s]){name}\s*:\s*(-?[0-9.]+)px", 1)
    return F.nullif(found, F.lit("")).cast("double")


_READ = {  # column: attribute
    "type": "type", "id": "id", "name": "name", "_class": "class", "placeholder": "placeholder", "aria_label": "aria-label",
    "_labelledby": "aria-labelledby", "autocomplete": "autocomplete", "role": "role", "_value": "value", "alt": "alt", "_style": "style",
    "_hidden": "hidden", "_aria_hidden": "aria-hidden", "for_id": "for", "href": "href",
}
_FOUND = ("tag", "inner", "value", "associated", "enclosing")
ROWS_AT_ONCE = 5_000


def tag_elements(pages: DataFrame, page_id: str = "page_id", html: str = "html", limit: int | None = None) -> DataFrame:
    """page_id, pos, and what one pass over the tags of a page tells about each element (``markup.elements``): its tag,
    attributes, inner text, value, and the texts of its first associated label and of the label around it.

    Pages are read where they are; nothing is shuffled. A null page has no elements.
    """
    ship_package(pages.sparkSession)
    source = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    text = [F.lit(None).cast("string").alias(c) for c in ("tag", "inner", "value", "associated", "enclosing", *_READ)]
    schema = source.select("page_id", F.lit(0).alias("pos"), *text).schema

    def told(batch, at, pos, rows):
        found = [pa.array([r[c] for r in rows], pa.string()) for c in _FOUND]
        read = [pa.array([r["attrs"].get(a) for r in rows], pa.string()) for a in _READ.values()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), *found, *read], names=schema.names
        )

    def run(batches):
        for batch in batches:
            at, pos, rows = [], [], []
            for i, page in enumerate(batch.column(1)):
                if page.is_valid:
                    new = markup.elements(page.as_py())[:limit]
                    at += [i] * len(new)
                    pos += range(len(new))
                    rows += new
                if len(rows) >= ROWS_AT_ONCE:
                    yield told(batch, at, pos, rows)
                    at, pos, rows = [], [], []
            yield told(batch, at, pos, rows)

    return source.mapInArrow(run, schema)


def snapshot_elements(pages: DataFrame, page_id: str = "page_id", html: str = "html", limit: int | None = None) -> DataFrame:
    """One row per element in document order; all of them, unless a ``limit`` per page is given.

    Texts are whole; what leaves in a payload is cut there. ``resolved_label`` is the text of the first label that is
    associated with the element, else of the label around it, else its aria-label, aria-labelledby, placeholder or name;
    ``label`` the same without label elements.
    """
    rows = tag_elements(pages, page_id, html, limit).withColumnRenamed("page_id", page_id)
    style = F.coalesce("_style", F.lit(""))
    width, height = _px(style, "width"), _px(style, "height")
    x, y = F.coalesce(_px(style, "left"), F.lit(0.0)), F.coalesce(_px(style, "top"), F.lit(0.0))
    tag, inner = F.col("tag"), F.col("inner")
    hints = F.when(tag == "img", E.joined("id", "_class", "alt"))
    caption = F.when(
        tag.isin("button", "a") | (F.coalesce("role", F.lit("")) == "button"), F.coalesce(E.filled(inner), F.trim("_value"), F.lit(""))
    )
    own = [E.filled(c) for c in ("aria_label", "_labelledby", "placeholder", "name")]
    return rows.select(
        page_id, "pos", "tag", "type", "id", "name",
        E.class_list(F.col("_class")).alias("classes"),
        F.coalesce(F.concat(F.lit("#"), E.filled("id")), F.concat(F.lit("e"), F.col("pos").cast("string"))).alias("selector"),
        caption.alias("text"),
        F.coalesce(*own).alias("label"),
        "placeholder", "aria_label", "autocomplete", "role", "value",
        tag.isin("img", "canvas").alias("is_img"),
        hints.alias("img_hints"),
        "alt",
        E.visible_from_markup(F.col("_hidden").isNotNull(), F.col("_aria_hidden"), F.col("_style"), width, height).alias("visible"),
        F.when(width.isNotNull() & height.isNotNull(), G.box(x, y, width, height)).alias("rect"),
        "for_id",
        F.when(tag == "label", inner).alias("label_text"),
        "href",
        "enclosing",
        F.coalesce(E.filled("associated"), E.filled("enclosing"), *own).alias("resolved_label"),
    )


def snapshot_labels(elements: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(page, for_id, pos, text) of the label elements of a snapshot."""
    return elements.filter((F.col("tag") == "label") & F.col("for_id").isNotNull()).select(
        page_id, "for_id", "pos", F.col("label_text").alias("text")
    )

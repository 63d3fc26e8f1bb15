"""Action plans, prompts and action targets as page-level jobs.

The elements of one page are the natural unit here: one shuffle by page gathers
everything that its plan needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import patterns as P
from veilspark.operators import classify as C
from veilspark.operators.elements import filled
from veilspark.session import grows

_ACTION = (
    "struct<action:string,selector:string,value:string,direction:string,distance:int,reasoning:string,"
    "confidence:double>"
)


def _rlike(column: Column, pattern: str) -> Column:
    return F.rlike(F.coalesce(column, F.lit("")), F.lit(P.java_regex(pattern, ignore_case=True)))


def shown() -> Column:
    return F.coalesce(F.col("visible"), F.lit(True))


def is_control() -> Column:
    """Candidate for the primary control of a page."""
    return shown() & (
        (F.col("tag") == "button")
        | ((F.col("tag") == "input") & F.lower(F.coalesce("type", F.lit(""))).isin("submit", "button"))
        | (F.coalesce("role", F.lit("")) == "button")
    )


def is_named_control() -> Column:
    return is_control() & (
        _rlike(F.col("text"), fixed.SUBMIT_WORDS)
        | _rlike(F.col("type"), fixed.SUBMIT_WORDS)
        | _rlike(F.col("label"), fixed.SUBMIT_WORDS)
    )


def primary_control(item: Column | None = None, control: Column | None = None, named: Column | None = None) -> Column:
    """Aggregate: first control with a submit word, else the last control."""
    control = is_control() if control is None else control
    named = is_named_control() if named is None else named
    item = F.struct("selector", "text", "label", "rect") if item is None else item
    return F.coalesce(
        F.min_by(F.when(named, item), F.when(named, F.col("pos"))),
        F.max_by(F.when(control, item), F.when(control, F.col("pos"))),
    )


def page_plans(elements: DataFrame, keys: Sequence[str], viewport_height: float | str = 800.0, task: Column | None = None) -> DataFrame:
    """One row per page: ``plan`` (array of actions) and ``has_empty``.

    Fields are planned once per selector in visual order (y, x, document order);
    captcha fields are planned even without a class. ``viewport_height`` may be a
    column of the page (800 where it is null or zero). A page without elements, as
    ``elements.on_all_pages`` gives it, has a plan that finishes at once.

    An element's own action is made before its page is gathered: the JVM compiles that, while what is written inside an
    aggregate or a lambda is interpreted row by row.
    """
    task = F.lit("") if task is None else task
    words = fixed.PLAN_TEXT
    known = F.col(viewport_height) if isinstance(viewport_height, str) else F.lit(float(viewport_height))

    def action(name: str, selector=None, value=None, direction=None, distance=None, reasoning=None, key=None) -> Column:
        def s(v, t="string"):
            return (v if isinstance(v, Column) else F.lit(v)).cast(t)

        return F.struct(
            F.lit(name).alias("action"),
            s("" if selector is None else selector).alias("selector"),
            s(value).alias("value"),
            s(direction).alias("direction"),
            s(distance, "int").alias("distance"),
            s(reasoning).alias("reasoning"),
            F.lit(fixed.PLAN_CONFIDENCE[key or name]).alias("confidence"),
        ).cast(_ACTION)

    name = F.substring(F.coalesce(filled("label"), F.col("selector")), 1, 32)
    tail = F.when(F.startswith(F.col("_fill"), F.lit("[")), words["fill_token"]).otherwise(words["fill_plain"])
    fill = action(
        "type", F.col("selector"), F.col("_fill"),
        reasoning=F.format_string(words["fill"], F.coalesce("field_kind", F.lit("field")), name, tail),
    )
    click_name = F.substring(F.coalesce(filled("text"), filled("label"), F.col("selector")), 1, 32)
    click = action("click", F.col("selector"), reasoning=F.format_string(words["click"], click_name))
    y, x = F.coalesce(F.col("rect.y"), F.lit(0.0)), F.coalesce(F.col("rect.x"), F.lit(0.0))
    bottom = (F.col("rect.y") + F.col("rect.height")).alias("bottom")
    rows = (
        C.with_audit_kind(elements)
        .withColumns({"_text": shown() & C.is_textual_for_audit(), "_control": is_control(), "_named": is_named_control()})
        .withColumn("_wanted", F.col("_text") & (F.col("field_kind").isNotNull() | _rlike(F.col("_actx"), fixed.AUDIT_CAPTCHA)))
        .withColumn("_fill", F.when(F.col("_wanted"), C.fill_value()))
        .select(
            *keys, "pos", "_control", "_named", known.alias("_known"),
            F.when(F.col("_wanted"), F.struct(y.alias("y"), x.alias("x"), "pos", "selector", bottom, fill.alias("act"))).alias("_field"),
            F.when(F.col("_control"), F.struct(bottom, click.alias("act"))).alias("_click"),
            (F.col("_text") & (F.trim(F.coalesce("value", F.lit(""))) == "")).alias("_empty"),
        )
    )
    names = F.transform("_all", lambda f: F.coalesce(f["selector"], F.lit("")))
    first = F.filter("_all", lambda f, i: F.array_position("_names", F.coalesce(f["selector"], F.lit(""))) == i + 1)
    per_page = (
        rows.groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list("_field")).alias("_all"),
            primary_control(F.col("_click"), F.col("_control"), F.col("_named")).alias("_submit"),
            F.coalesce(F.bool_or("_empty"), F.lit(False)).alias("has_empty"),
            F.coalesce(F.nullif(F.max("_known"), F.lit(0.0)), F.lit(float(fixed.DEFAULT_VIEWPORT[1]))).alias("_height"),
        )
        .withColumn("_names", names)
        # few pages repeat a selector; only these are searched for the first of each
        .withColumn("_fields", F.when(F.size(F.array_distinct("_names")) == F.size("_names"), F.col("_all")).otherwise(first))
    )
    fold = F.col("_height") * fixed.FOLD_SHARE

    def below(r: Column) -> Column:
        return F.coalesce(r["bottom"] > fold, F.lit(False))

    none = F.array().cast(f"array<{_ACTION}>")
    submit = F.col("_submit")
    scroll = F.when(
        F.exists("_fields", below) | below(submit),
        F.array(
            action("scroll", direction="down", distance=F.col("_height") * fixed.SCROLL_SHARE, reasoning=words["scroll"])
        ),
    ).otherwise(none)
    finish = action(
        "finish",
        reasoning=F.format_string(
            words["finish"],
            F.substring(task, 1, 60),
            F.size("_fields"),
            F.when(submit.isNotNull(), "yes").otherwise("no"),
        ),
    )
    return per_page.select(
        *keys, "has_empty",
        F.concat(
            scroll, F.transform("_fields", lambda f: f["act"]), F.when(submit.isNotNull(), F.array(submit["act"])).otherwise(none),
            F.array(finish),
        ).alias("plan"),
    )


def plan_rows(plans: DataFrame, *keys: str) -> DataFrame:
    # outer form: the inner one would repeat the plan expression in a size filter
    rows = plans.select(*keys, F.posexplode_outer("plan").alias("step", "_a")).filter(F.col("_a").isNotNull())
    return rows.select(*keys, "step", "_a.*")


def answer_calls(calls: DataFrame, plans: DataFrame, keys: Sequence[str], call: str) -> DataFrame:
    """Action for the n-th call (0-based) of each page: the plan in order, then
    the plan again while fields are empty, else finish, which is also the answer for a page without a plan."""
    n, length = F.col(call), F.size("plan")
    again = (n < length) | F.col("has_empty")
    picked = F.element_at("plan", (n % length + 1).cast("int"))
    return (
        calls.join(plans, list(keys), "left")
        .withColumn("_p", F.when(again, picked))
        .select(
            *calls.columns,
            F.coalesce("_p.action", F.lit("finish")).alias("action"),
            F.coalesce("_p.selector", F.lit("")).alias("selector"),
            F.col("_p.value").alias("value"),
            F.coalesce("_p.reasoning", F.lit(fixed.PLAN_TEXT["idle"])).alias("reasoning"),
            F.coalesce("_p.confidence", F.lit(fixed.PLAN_CONFIDENCE["idle"])).alias("confidence"),
        )
    )


def summary_line() -> Column:
    def part(prefix: str, c: Column) -> Column:
        return F.concat(F.lit(prefix), filled(c))

    at = F.when(
        F.col("rect").isNotNull(),
        F.format_string("at=(%d,%d)", F.col("rect.x").cast("int"), F.col("rect.y").cast("int")),
    )
    return F.concat(
        F.lit("  "),
        F.concat_ws(
            " ",
            "tag",
            F.coalesce("selector", F.lit("")),
            part("type=", F.col("type")),
            part("label=", F.substring("label", 1, 40)),
            part("ac=", F.col("autocomplete")),
            part("value=", F.substring("value", 1, 24)),
            at,
        ),
    )


def page_summary(elements: DataFrame, *keys: str, limit: int = fixed.SUMMARY_LINES) -> DataFrame:
    """First lines of a page in document order, joined into one text."""
    line = F.when(F.col("pos") < limit, F.struct("pos", summary_line().alias("line")))
    return (
        elements.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(line)).alias("_lines"))
        .select(
            *keys,
            F.coalesce(
                filled(F.array_join(F.transform("_lines", lambda s: s["line"]), "\n")), F.lit(fixed.EMPTY_SUMMARY)
            ).alias("summary"),
        )
    )


def prompt(task: Column, url: Column, step: Column, width: Column, height: Column, summary: Column) -> Column:
    return F.format_string(
        fixed.PROMPT_TEXT, task, F.coalesce(filled(url), F.lit("(unknown)")), step,
        width.cast("int"), height.cast("int"), summary,
    )


def action_targets(
    actions: DataFrame, elements: DataFrame, page: Sequence[str], action_id: str, text_first: str = "text", tasks: int | None = None
) -> DataFrame:
    """Element an action points at: exact selector, then ``#id`` (final), then
    name, then ``text=`` on buttons and links; NULL when nothing fits.

    All four look-ups meet the elements in one window over (page, way, key), which moves no row where both sides come
    dealt by page: a task holds its own pages only, whatever the session's number of shuffle partitions. ``tasks``: to how
    many the answers and the actions are dealt to meet again; without it, to that number.
    """
    button = (
        F.col("tag").isin("button", "a")
        | ((F.col("tag") == "input") & (F.coalesce("type", F.lit("")) == "submit"))
        | (F.coalesce("role", F.lit("")) == "button")
    )
    caption = F.lower(F.trim(F.coalesce(filled(text_first), F.col("value"), F.lit(""))))
    names = ("selector", "id", "name", "text")

    def ways(*keys: Column) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(i).alias("_rank"), k.alias("_key")) for i, k in enumerate(keys)])).alias("_k")

    def side(rows: DataFrame, pos: Column, asker: Column, asks: bool) -> DataFrame:
        return rows.filter(F.col("_k._key").isNotNull()).select(
            *page, "_k._rank", "_k._key", pos.alias("_pos"), asker.alias("_asker"), F.lit(asks).alias("_asks")
        )

    places = elements.select(
        *page, "pos", ways(F.col("selector"), F.col("id"), F.col("name"), F.when(button, caption))
    )
    s = F.col("selector")
    id_form = F.rlike(s, F.lit(r"^#[\w-]+$"))
    asked = actions.select(
        *page, action_id,
        ways(
            s,
            F.when(id_form, F.regexp_replace(s, "^#", "")),
            F.when(~id_form, F.regexp_replace(s, r'["\\]', "")),
            F.when(~id_form, F.lower(F.trim(filled(F.regexp_extract(s, r"^text=(.+)$", 1))))),
        ),
    )
    none = F.lit(None)
    met = side(places, F.col("pos"), none.cast(actions.schema[action_id].dataType), False).unionByName(
        side(asked, none.cast(elements.schema["pos"].dataType), F.col(action_id), True)
    )
    found = met.withColumn("_hit", F.min("_pos").over(Window.partitionBy(*page, "_rank", "_key"))).filter(
        F.col("_asks") & F.col("_hit").isNotNull()
    )
    best = found.groupBy(*page, F.col("_asker").alias(action_id)).agg(
        *[F.min(F.when(F.col("_rank") == i, F.col("_hit"))).alias(f"_hit{i}") for i in range(len(names))]
    )

    def dealt(rows: DataFrame) -> DataFrame:
        return rows if tasks is None else rows.repartition(tasks, *page, action_id)

    hits = [F.col(f"_hit{i}") for i in range(len(names))]
    return grows(dealt(actions)).join(dealt(best), [*page, action_id], "left").select(
        *actions.columns,
        F.coalesce(*[F.when(h.isNotNull(), F.lit(n)) for h, n in zip(hits, names, strict=True)]).alias("way"),
        F.coalesce(*hits).alias("target_pos"),
    )


def dangling(actions: DataFrame, elements: DataFrame, *page: str) -> DataFrame:
    """Actions that name a selector their page does not have."""
    return actions.filter(F.coalesce("selector", F.lit("")) != "").join(
        elements.select(*page, "selector"), [*page, "selector"], "left_anti"
    )

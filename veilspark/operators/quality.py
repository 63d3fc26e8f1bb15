"""Contract checks: payloads, actions, model responses, submitted forms."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import patterns as P


def record_is_valid(text: Column, session: Column, step: Column) -> Column:
    """A turn of a conversation: some text, a session and a step."""
    return F.coalesce((F.length(text) > 0) & F.length(session).between(1, 128) & (step >= 0), F.lit(False))


def payload_is_valid(task: Column, session: Column, step: Column) -> Column:
    return F.coalesce(
        F.length(task).between(1, 2000) & F.length(session).between(1, 128) & (step >= 0), F.lit(False)
    )


def has_screenshot(encoded: Column) -> Column:
    return F.length(F.coalesce(encoded, F.lit(""))) > 128


def kilobytes(encoded: Column) -> Column:
    return F.bround(F.length(F.coalesce(encoded, F.lit(""))) / 1024, 1)


def is_sensitive_field() -> Column:
    auto = F.coalesce("autocomplete", F.lit(""))
    return (
        (F.lower(F.coalesce("type", F.lit(""))) == "password") | F.startswith(auto, F.lit("cc-")) | (auto == "one-time-code")
    )


def _needs_selector() -> Column:
    return F.col("action").isin("click", "type") & (F.coalesce("selector", F.lit("")) == "")


def action_ok_for_client() -> Column:
    known = F.coalesce(F.col("action").isin(*fixed.ACTIONS), F.lit(False))
    return known & ~_needs_selector() & F.coalesce("confidence", F.lit(0.8)).between(0, 1)


def action_ok_for_server() -> Column:
    return (
        action_ok_for_client()
        & ~((F.col("action") == "type") & F.col("value").isNull())
        & F.coalesce(F.col("direction").isin("up", "down"), F.lit(True))
        & F.coalesce(F.col("distance").between(0, 10000), F.lit(True))
    )


def repaired_actions(df: DataFrame, response: str, *keep: str) -> DataFrame:
    """Action out of a model response: fences stripped, whole text or the outermost
    braces parsed, defaults applied; what cannot be repaired, or has a field of a
    wrong type, has an ``error``."""
    text = F.trim(F.regexp_replace(F.trim(F.col(response)), r"(?m)^```(?:json)?|```$", ""))
    braces = F.regexp_extract("_t", r"(?s)\{.*\}", 0)
    first = F.try_parse_json("_t")
    parsed = F.coalesce(first, F.try_parse_json(F.when(braces != "", braces)))

    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("_v", f"$.{name}", kind)

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant")), F.lit("VOID"))

    texts, numbers = ("selector", "value", "direction", "reasoning"), ("confidence", "distance")
    wrong_type = reduce(or_, [
        *[~kind(n).isin("STRING", "VOID") for n in texts],
        *[~F.rlike(kind(n), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)$")) for n in numbers],
    ])
    is_object = F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT"))
    action = F.when(F.coalesce(field("action").isin(*fixed.ACTIONS), F.lit(False)), field("action")).otherwise("finish")
    out = (
        df.select(*keep, text.alias("_t"))
        .withColumn("_v", parsed)
        .withColumn("_o", F.coalesce(is_object, F.lit(False)))
        .select(
            *keep,
            "_t",
            "_o",
            F.col("_v").isNotNull().alias("_json"),
            F.when(F.col("_o"), action).alias("action"),
            F.when(F.col("_o"), F.coalesce(field("selector"), F.lit(""))).alias("selector"),
            F.when(
                F.col("_o"), F.when((action == "type") & field("value").isNull(), "").otherwise(field("value"))
            ).alias("value"),
            F.when(F.col("_o"), F.coalesce(field("confidence", "double"), F.lit(0.8))).alias("confidence"),
            field("direction").alias("direction"),
            field("distance", "int").alias("distance"),
            F.when(F.col("_o"), F.coalesce(field("reasoning"), F.lit(""))).alias("reasoning"),
            wrong_type.alias("_wrong"),
        )
    )
    error = (
        F.when(F.coalesce("_t", F.lit("")) == "", "empty response")
        .when(~F.col("_json"), "no JSON")
        .when(~F.col("_o"), "not an object")
        .when(F.col("_wrong"), "wrong type")
        .when(~action_ok_for_server(), "invalid action")
    )
    return out.withColumn("error", error).drop("_t", "_o", "_json", "_wrong")


def form_errors(wide: DataFrame) -> DataFrame:
    """Messages of the page checks per submitted form; ``valid`` when none applies.

    ``wide`` has one row per form: ``form`` (login, checkout, kyc) and one column
    per field, NULL when the form lacks it.
    """
    def text(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit("")))

    def like(c: Column, pattern: str) -> Column:
        return F.rlike(c, F.lit(pattern))

    idnum = F.regexp_replace(F.coalesce("idnum", F.lit("")), f"[{P.WHITE_SPACE}]", "")
    known_id = like(idnum, "|".join(fixed.FORM_ID_PATTERNS))
    form = fixed.FORM_PATTERNS
    checks = {
        "login": [
            ~like(text("otp"), form["otp"]),
            text("captcha") != fixed.FILL_LITERALS["captcha"],
        ],
        "checkout": [
            text("fullname") == "",
            ~like(text("phone"), form["phone"]),
            ~F.coalesce(P.luhn_ok(F.col("card")), F.lit(False)),
            ~like(text("expiry"), form["expiry"]),
            ~like(text("cvv"), form["cvv"]),
            text("address") == "",
        ],
        "kyc": [
            F.length(text("fullname")) < 3,
            F.coalesce("dob", F.lit("")) == "",
            ~known_id,
            text("address") == "",
            ~F.coalesce(F.col("consent"), F.lit(False)),
        ],
    }
    messages = [
        F.when((F.col("form") == name) & bad, F.lit(message))
        for name, rules in checks.items() for bad, message in zip(rules, fixed.FORM_MESSAGES[name], strict=True)
    ]
    return wide.withColumn("errors", F.array_compact(F.array(*messages))).withColumn("valid", F.size("errors") == 0)

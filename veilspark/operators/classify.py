"""Element classification as one first-hit CASE expression per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import patterns as P
from veilspark.operators import elements as E
from veilspark.operators.rules import first_matches, required

def _lower(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def _rlike(column: str, pattern: str, low: str | None = None) -> str:
    """SQL text of a case-insensitive match; raw literals keep the backslashes.

    Only a text that holds a literal of one of the pattern's branches can match: these are sought first, in ``low``, the
    text in lower case, as that costs a small part of a pattern tried at every place.
    """
    whole = f'rlike({column}, r"{P.java_regex(pattern, ignore_case=True)}")'
    found = set(required(pattern))
    literals = sorted(x for x in found if not any(y in x for y in found - {x}))
    if "" in found or not all(x.isascii() for x in found):
        return whole
    held = " OR ".join(f'contains({low or f"lower({column})"}, r"{x}")' for x in literals)
    return f"(({held}) AND {whole})"


def _in(column: str, values) -> str:
    return f"{column} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


_Rule = tuple[str, str, float, str]
"""Condition, class, confidence and evidence, as SQL."""


def _first(rules: list[_Rule], begin: int = 0) -> str:
    """Number of the first rule that hits, from ``begin`` + 1, or NULL."""
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {i}" for i, r in enumerate(rules, begin + 1)) + " END"


def _detection(rules: list[_Rule], number: str, untokenised: int) -> str:
    """Detection struct of the rule of that number, NULL for none; the rule ``untokenised`` has no token kind.

    Numbers first and details after them: together they make a method too large for the JVM to compile.
    """
    def pick(values: list[str]) -> str:
        return f"element_at(array({', '.join(values)}), {number})"

    types = [r[1] for r in rules]
    kinds = [
        "CAST(NULL AS STRING)" if i == untokenised else f"'{fixed.TOKEN_KIND.get(t, fixed.DEFAULT_KIND)}'" for i, t in enumerate(types, 1)
    ]
    modes = [f"'{fixed.REDACTION_MODE.get(t, fixed.DEFAULT_MODE)}'" for t in types]
    told = " ".join(f"WHEN {i} THEN {r[3]}" for i, r in enumerate(rules, 1))
    return (
        f"CASE WHEN {number} IS NOT NULL THEN named_struct('pii_type', {pick([repr(t) for t in types])}, "
        f"'confidence', {pick([f'{r[2]}D' for r in rules])}, 'evidence', CASE {number} {told} END, "
        f"'mode', {pick(modes)}, 'token_kind', {pick(kinds)}) END"
    )


def is_textual(types: tuple[str, ...]) -> Column:
    return (F.col("tag") == "textarea") | ((F.col("tag") == "input") & _lower("type").isin(*types))


def fence(column: str) -> Column:
    """The column unchanged, as a one-element generator.

    A filter on a generated column stays above it.  Without this the optimizer
    would copy the whole rule expression into a filter below, with the context
    string repeated in every arm.
    """
    return F.explode_outer(F.array(column))


_FIELD = "tag IN ('input', 'textarea')"
_TEXTUAL = (
    "(tag = 'textarea' OR (tag = 'input' AND " + _in("_type", fixed.TEXTUAL_TYPES_DETECTOR) + "))"
)


def element_rules() -> list[_Rule]:
    """Ordered rules over ``_type``, ``_auto``, ``_ctx``, ``_low`` and ``_image``; the first is that of image regions."""
    rules = [
        (
            f"(tag = 'img' OR coalesce(is_img, false)) AND {_rlike('_image', fixed.PHOTO_WORDS)}",
            "photo", 0.80, "concat('image region: ', substring(_image, 1, 40))",
        ),
        (f"{_FIELD} AND _type = 'password'", "password", 0.99, "'type=password'"),
        (f"{_FIELD} AND (_type = 'email' OR _auto = 'email')", "email", 0.95, "'email field'"),
        (f"{_FIELD} AND (_type = 'tel' OR _auto IN ('tel', 'mobile'))", "phone", 0.93, "'tel field'"),
        (
            f"{_FIELD} AND _type = 'date' AND " + _rlike("_ctx", fixed.BIRTH_HINT, "_low"),
            "dob", 0.93, "'date-of-birth field'",
        ),
    ]
    for name, pii_type in fixed.AUTOCOMPLETE_CLASS.items():
        rules.append((f"_auto = '{name}'", pii_type, fixed.AUTOCOMPLETE_CONFIDENCE, f"'autocomplete={name}'"))
    rules.append(("_auto = 'cc-name'", "name", 0.90, "'autocomplete=cc-name'"))
    rules.append(("_auto = 'one-time-code'", "otp", 0.95, "'autocomplete=one-time-code'"))
    for _, pattern, pii_type, confidence in fixed.KEYWORD_RULES:
        word = f'regexp_extract(_ctx, r"{P.java_regex(pattern, ignore_case=True)}", 0)'
        rules.append((_rlike("_ctx", pattern, "_low"), pii_type, confidence, f"concat('context \"', {word}, '\"')"))
    return rules


def later_rules() -> list[_Rule]:
    """Rules after those: of text fields by their context, then over ``_hits``, the findings of the value."""
    rules = [
        (f"{_TEXTUAL} AND {_rlike('_ctx', pattern, '_low')}", pii_type, confidence, f"'{pii_type} context'")
        for pattern, pii_type, confidence in fixed.GATED_RULES
    ]
    rules.append(("exists(_hits, f -> f.type = 'credit_card')", "credit_card", 0.96, "'value pattern: credit_card'"))
    for name in ("email", "phone", "ssn", "national_id", "dob"):
        rules.append((f"try_element_at(_hits, 1).type = '{name}'", name, 0.88, f"'value pattern: {name}'"))
    return rules


def _context() -> Column:
    return E.joined("id", "name", "classes", "label", "placeholder", "aria_label", "autocomplete", "role", "selector")


def with_detection(elements: DataFrame, include_invisible: bool = False) -> DataFrame:
    """Add ``det``: class, confidence, evidence, mode and token kind, or NULL.

    Elements that are off screen never get a detection; image regions with
    photo words are blurred and have no token.
    """
    image_ctx = E.joined("id", "name", "classes", "alt", "aria_label", "selector", "img_hints")
    rules, later = element_rules(), later_rules()
    boxed = F.coalesce((F.col("rect.width") > 1) & (F.col("rect.height") > 1), F.lit(True))
    shown = E.is_on_screen(include_invisible) & boxed
    # Values are read only where no earlier rule hits; a file field's value is no text of the user's.
    value = F.when(_lower("type") == "file", F.lit("")).otherwise(F.coalesce("value", F.lit("")))
    return (
        elements.withColumns({"_type": _lower("type"), "_auto": _lower("autocomplete"), "_ctx": _context(), "_image": image_ctx, "_shown": shown})
        .withColumn("_low", F.lower("_ctx"))
        .withColumn("_told", F.when(F.col("_shown"), F.expr(_first(rules))))
        .withColumn("_hits", F.when(F.col("_shown") & F.col("_told").isNull(), P.scan_text(value)))
        .withColumn("_no", F.when(F.col("_shown"), F.coalesce("_told", F.expr(_first(later, len(rules))))))
        .withColumn("_det", F.expr(_detection(rules + later, "_no", untokenised=1)))
        .select(*elements.columns, fence("_det").alias("det"))
    )


def detections(classified: DataFrame, *keys: str) -> DataFrame:
    """Detection rows of a classified element table."""
    return classified.filter(F.col("det").isNotNull()).select(
        *keys,
        "pos",
        "selector",
        F.col("rect").alias("box"),
        "det.*",
        F.lit("dom").alias("source"),
        "tag",
    )


def rule_table(spark, rules=fixed.KEYWORD_RULES) -> DataFrame:
    """The keyword rules as data; users may append rows of their own."""
    rows = [(p, P.java_regex(rx, ignore_case=True), c, float(s)) for p, rx, c, s in rules]
    return spark.createDataFrame(rows, "priority int, pattern string, pii_type string, confidence double")


def classify_by_rule_table(elements: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """First matching keyword rule per element, with the rules read as data: any number of them, indexed by literals."""
    found = first_matches(elements.select(*keys, "pos", _context().alias("_ctx")), "_ctx", rules)
    return found.select(*keys, "pos", "rule.priority", "rule.pii_type", "rule.confidence")


# ---------------------------------------------------------------------------
# the independent audit's own reading of a sanitised element
# ---------------------------------------------------------------------------
def audit_context() -> Column:
    return E.joined(
        "id", "name", "label", "placeholder", "aria_label", "autocomplete", "role", "selector", "text", "img_hints"
    )


def with_audit_kind(elements: DataFrame) -> DataFrame:
    """Add ``field_kind`` (or NULL) and keep ``_actx`` for later rules."""
    kind, auto = "_atype", "_aauto"  # made once an element and not once a rule
    rules = [
        (f"{_FIELD} AND {kind} = 'password'", "password"),
        (f"{_FIELD} AND ({kind} = 'email' OR {auto} = 'email')", "email"),
        (f"{_FIELD} AND ({kind} = 'tel' OR {auto} IN ('tel', 'mobile'))", "phone"),
    ]
    rules += [(f"{auto} = '{name}'", pii_type) for name, pii_type in fixed.AUTOCOMPLETE_CLASS.items()]
    rules.append((f"{auto} = 'one-time-code'", "otp"))
    def says(pattern: str) -> str:
        return _rlike("_actx", pattern, "_alow")

    rules += [(says(rx), pii_type) for _, rx, pii_type in fixed.AUDIT_KEYWORD_RULES]
    rules += [
        (says(fixed.AUDIT_EMAIL), "email"),
        (says(fixed.AUDIT_PHONE), "phone"),
        (f"{_FIELD} AND {says(fixed.AUDIT_NAME)}", "name"),
        (says(fixed.AUDIT_ADDRESS), "address"),
    ]
    case = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + " END"
    return (
        elements.withColumns({"_atype": _lower("type"), "_aauto": _lower("autocomplete"), "_actx": audit_context()})
        .withColumn("_alow", F.lower("_actx"))
        .withColumn("_kind", F.expr(case))
        .select(*elements.columns, "_actx", fence("_kind").alias("field_kind"))
    )


def fill_value() -> Column:
    """Value a planned type action writes; needs ``_actx`` and ``field_kind``."""
    literal = fixed.FILL_LITERALS
    arms = [
        (_rlike("_actx", fixed.AUDIT_CAPTCHA), literal["captcha"]),
        (_rlike("_actx", fixed.AUDIT_COUNTRY), literal["country"]),
        (_rlike("_actx", fixed.AUDIT_ID_TYPE), literal["id_type"]),
        (f"field_kind = 'address' AND {_rlike('_actx', fixed.AUDIT_CITY)}", literal["city"]),
        (f"field_kind = 'address' AND {_rlike('_actx', fixed.AUDIT_ZIP)}", literal["zip"]),
        (f"field_kind = 'address' AND {_rlike('_actx', fixed.AUDIT_STATE)}", literal["state"]),
    ]
    arms += [(f"field_kind = '{kind}'", token) for kind, token in fixed.FILL_TOKEN.items()]
    return F.expr("CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in arms) + f" ELSE '{literal['other']}' END")


def is_textual_for_audit() -> Column:
    return is_textual(fixed.TEXTUAL_TYPES_AUDIT)


def first_per_selector(page: list[str]) -> Window:
    """Whole (page, selector) group in document order; bounded by the element cap."""
    return Window.partitionBy(*page, "selector").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )

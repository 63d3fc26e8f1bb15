"""Text patterns as Spark column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed

_WORD = "[A-Za-z0-9_]"
# white space as the contract defines it; Java's own \s is ASCII only
WHITE_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

_EMPTY_FINDINGS = "array<struct<type:string,value:string>>"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Render a contract pattern for Java.

    ``\\b`` becomes an explicit ASCII boundary because Java's own is
    Unicode-aware.  Where the neighbouring pattern item must be a word
    character, the one-sided look-around is equivalent and cheaper.
    """
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            after, before = pattern[i + 2:], pattern[:i]
            if re.match(r"\\d|\[6-9\]|\(\?:\\d|\(19|[A-Za-z]", after):
                out.append(f"(?<!{_WORD})")
            elif re.search(r"(?<!\\)[A-Za-z]$|\\d\{\d\}$|\[A-Za-z\]\{2,\}$|3\[01\]\)$", before):
                out.append(f"(?!{_WORD})")
            else:
                out.append(f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))")
            i += 2
        elif pattern.startswith(r"\s", i):
            inside = pattern.rfind("[", 0, i) > pattern.rfind("]", 0, i)
            out.append(WHITE_SPACE if inside else f"[{WHITE_SPACE}]")
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def _java_text_regex(kind: str, pattern: str) -> str:
    rendered = java_regex(pattern)
    if kind == "email":  # '@' is outside the class, so the possessive form matches the same text
        rendered = rendered.replace("[A-Za-z0-9._%+-]+@", "[A-Za-z0-9._%+-]++@", 1)
    return rendered


TEXT_REGEX = {kind: _java_text_regex(kind, p) for kind, p in fixed.TEXT_PATTERNS}
TOKEN_WHOLE = fixed.TOKEN_WHOLE
TOKEN_BRACKETED = fixed.TOKEN_BRACKETED
# every numeric pattern has a digit followed by at least eight digits, dashes or blanks;
# the class leaves out ASCII letters and all other ASCII punctuation
NUMERIC_GUARD = "[0-9][^!-,./:-~]{8}"


def luhn_ok(value: Column) -> Column:
    """12 to 19 digits (spaces and dashes ignored) with a valid check digit."""
    digits = F.regexp_replace(value, "[ -]", "")
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


def matches(kind: str, text: Column) -> Column:
    """All matches of one pattern, left to right; cards only when Luhn-valid."""
    found = F.regexp_extract_all(text, F.lit(TEXT_REGEX[kind]), F.lit(0))
    if kind == "credit_card":
        found = F.filter(found, luhn_ok)
    return found


def scan_text(text: Column) -> Column:
    """Findings of a text: array of (type, value) in pattern order, overlaps kept.

    Two cheap guards keep the six patterns away from texts that cannot match.
    """
    def tagged(kind: str) -> Column:
        return F.transform(
            matches(kind, text), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
        )

    empty = F.array().cast(_EMPTY_FINDINGS)
    email = F.when(F.contains(text, F.lit("@")), tagged("email")).otherwise(empty)
    numeric = F.when(
        F.rlike(text, F.lit(NUMERIC_GUARD)),
        F.concat(*[tagged(k) for k, _ in fixed.TEXT_PATTERNS if k != "email"]),
    ).otherwise(empty)
    return F.concat(email, numeric)


_BETWEEN = "[!-*,./:-~]"
"""ASCII letters and punctuation that stand in no match of a numeric pattern; Java tries such a class fast."""


def around_numbers(text: Column) -> Column:
    """The text without most of what lies between its numbers, for the numeric patterns, which cost much at every place.

    They match digits, signs and white space only and look at one character on either side, so of each run of ASCII
    letters and punctuation the first and the last are kept: the matches are the same.
    """
    return F.regexp_replace(text, f"({_BETWEEN}){_BETWEEN}+({_BETWEEN})", "$1$2")


def count_leaks(df: DataFrame, column: str, output: str) -> DataFrame:
    """``df`` with the number of findings (``scan_text``) in the text outside its tokens. Each step is a column of its
    own, as the optimizer would repeat it for each pattern otherwise."""
    text, numbers = F.col("_text"), F.col("_numbers")
    prepared = df.withColumn("_text", strip_tokens(F.col(column))).withColumn(
        "_numbers", F.when(F.rlike(text, F.lit(NUMERIC_GUARD)), around_numbers(text))
    )
    n = F.when(F.contains(text, F.lit("@")), F.size(matches("email", text))).otherwise(0)
    for kind, _ in fixed.TEXT_PATTERNS:
        if kind != "email":
            n += F.when(numbers.isNotNull(), F.size(matches(kind, numbers))).otherwise(0)
    return prepared.withColumn(output, n).drop("_text", "_numbers")


def has_finding(text: Column) -> Column:
    """True when any pattern matches, without building the list."""
    numeric = F.rlike(text, F.lit(NUMERIC_GUARD)) & (
        F.rlike(text, F.lit(TEXT_REGEX["phone"]))
        | F.rlike(text, F.lit(TEXT_REGEX["ssn"]))
        | F.rlike(text, F.lit(TEXT_REGEX["national_id"]))
        | F.rlike(text, F.lit(TEXT_REGEX["dob"]))
        | (F.size(matches("credit_card", text)) > 0)
    )
    email = F.contains(text, F.lit("@")) & F.rlike(text, F.lit(TEXT_REGEX["email"]))
    return F.coalesce(email | numeric, F.lit(False))


def strip_tokens(text: Column) -> Column:
    """Empty every bracketed token so that a token can never look like a value."""
    return F.regexp_replace(text, TOKEN_BRACKETED, "[]")


def is_token(value: Column) -> Column:
    return F.rlike(value, F.lit(TOKEN_WHOLE))


def named_tokens(text: Column) -> Column:
    """Tokens of the known kinds inside a text, left to right."""
    return F.regexp_extract_all(text, F.lit(fixed.TOKEN_NAMED), F.lit(0))


def masked(value: Column, shown: int | Column, tail: str = "***") -> Column:
    shown = F.lit(shown) if isinstance(shown, int) else shown
    return F.concat(F.substring(value, F.lit(1), shown), F.lit(tail))


def audit_hint(kind: Column, value: Column) -> Column:
    """Masked hint with the visible length the audit allows per class."""
    arms = None
    for name, shown in fixed.AUDIT_HINT_CHARS.items():
        text = masked(value, shown, "****" if name == "credit_card" else "***")
        arms = F.when(kind == name, text) if arms is None else arms.when(kind == name, text)
    return arms


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Small fixed table as a CASE expression; unknown keys give NULL."""
    arms = None
    for name, value in table.items():
        arms = F.when(key == name, F.lit(value)) if arms is None else arms.when(key == name, F.lit(value))
    return arms


def redact_text(df: DataFrame, column: str, output: str) -> DataFrame:
    """Replace each finding by the bracketed token kind of its class.

    E-mail addresses go first, so that digits inside an address stay part of it.
    Then cards, only where Luhn-valid: their texts (digits and separators, hence
    literal in a pattern) form an alternation, longest first, so that a shorter
    number never cuts into a longer one and the separator after a card stays.
    """
    def token(kind: str) -> Column:
        return F.lit(f"[{fixed.TOKEN_KIND[kind]}]")

    source = F.col(column)
    text = F.col("_mail_free")
    numeric = F.rlike(source, F.lit(NUMERIC_GUARD))
    cards = F.array_distinct(
        F.transform(matches("credit_card", text), lambda v: F.regexp_replace(v, "[ -]+$", ""))
    )
    by_length = F.array_sort(F.transform(cards, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))
    longest_first = F.transform(F.reverse(by_length), lambda s: s["v"])
    alternation = F.concat(
        F.lit(f"(?<!{_WORD})(?:"), F.array_join(longest_first, "|"), F.lit(f")(?!{_WORD})")
    )
    cleaned = F.when(
        F.col("_cards") == "", text
    ).otherwise(F.regexp_replace(text, F.col("_cards"), token("credit_card")))
    for kind in ("phone", "ssn", "national_id", "dob"):
        cleaned = F.regexp_replace(cleaned, F.lit(TEXT_REGEX[kind]), token(kind))
    return (
        df.withColumn("_numeric", numeric)
        .withColumn(
            "_mail_free",
            F.when(
                F.contains(source, F.lit("@")),
                F.regexp_replace(source, F.lit(TEXT_REGEX["email"]), token("email")),
            ).otherwise(source),
        )
        .withColumn(
            "_cards",
            F.when(F.col("_numeric"), F.when(F.size(cards) > 0, alternation).otherwise("")).otherwise(""),
        )
        .withColumn(output, F.when(F.col("_numeric"), cleaned).otherwise(text))
        .drop("_numeric", "_mail_free", "_cards")
    )

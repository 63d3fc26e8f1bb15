import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.functions import patterns as P


def scan(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", P.scan_text(F.col("t")).alias("f"), P.has_finding(F.col("t")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in rows] == [len(r["f"]) > 0 for r in rows]
    return [[(x["type"], x["value"]) for x in r["f"]] for r in rows]


def redact(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["out"] for r in P.redact_text(df, "t", "out").orderBy("i").collect()]


def luhn(number):
    digits = re.sub("[ -]", "", number)
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return 12 <= len(digits) <= 19 and total % 10 == 0


def brute_scan(text):
    """The patterns in Python's ASCII mode; white space as the contract has it."""
    out = []
    for kind, pattern in fixed.TEXT_PATTERNS:
        pattern = pattern.replace(r"\s", r"[\t\n\x0b\x0c\r    -     　﻿]")
        for m in re.finditer(pattern, text, re.ASCII):
            if kind != "credit_card" or luhn(m.group(0)):
                out.append((kind, m.group(0)))
    return out


def test_each_class(spark):
    got = scan(spark, "a b@c.de", "9876543210", "123-45-6789", "2345 6789 0123", "1996-04-17", "4111-1111-1111-1111", None, "")
    assert got[0] == [("email", "b@c.de")]
    assert got[1] == [("phone", "9876543210")]
    assert got[2] == [("ssn", "123-45-6789")]
    assert got[3] == [("national_id", "2345 6789 0123")]
    assert got[4] == [("dob", "1996-04-17")]
    assert got[5] == [("credit_card", "4111-1111-1111-1111")]
    assert got[6] == [] and got[7] == []


def test_accented_neighbour_is_a_boundary(spark):
    assert scan(spark, "é4111111111111111é") == [[("credit_card", "4111111111111111")]]


def test_country_prefix_forms(spark):
    a, b, c = scan(spark, "+919876543210", "+91 98765 43210", "(499) 555-6503")
    assert a == [("national_id", "919876543210")] and b == [] and c == []


def test_spaced_card_is_counted_twice(spark):
    assert scan(spark, "4111 1111 1111 1111") == [[("national_id", "4111 1111 1111"), ("credit_card", "4111 1111 1111 1111")]]


def test_no_break_space_inside_id(spark):
    assert scan(spark, "2345 6789 0123") == [[("national_id", "2345 6789 0123")]]


def test_any_iso_date_is_dob(spark):
    assert scan(spark, "shipped 2024-01-31, 2024-13-01, 1899-01-01") == [[("dob", "2024-01-31")]]


@pytest.mark.parametrize("number,ok", [("4111 1111 1111 1111", True), ("1234567812345678", False), ("0" * 12, True),
                                       ("0" * 11, False), ("0" * 19, True), ("0" * 20, False), ("4111x1111", False)])
def test_luhn(spark, number, ok):
    row = spark.createDataFrame([(number,)], "v string").select(P.luhn_ok(F.col("v")).alias("ok")).first()
    assert row["ok"] is ok


def test_random_texts_match_brute_force(spark):
    rng = random.Random(7)
    pool = list("0123456789") * 4 + list(" -.@+_aZé \n%") + ["4111 1111 1111 1111", "x@y.io", "1999-12-31", "+91 ", "123-45-6789"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(5, 60))) for _ in range(1500)]
    for text, got in zip(texts, scan(spark, *texts)):
        assert got == brute_scan(text), text


def test_redaction_keeps_the_separator_after_a_card(spark):
    a, b, c = redact(spark, "pay 4111 1111 1111 1111 now", "1234567812345678 stays", "mail a.b@c.de, ssn 123-45-6789")
    assert a == "pay [CARD_NUMBER] now"
    assert b == "1234567812345678 stays"
    assert c == "mail [USER_EMAIL], ssn [NATIONAL_ID]"


def test_redaction_twice_is_once(spark):
    once = redact(spark, "u1@ex.com 4111111111111111 4111 1111 1111 1111 9876543210 1990-01-01 2345 6789 0123")
    assert redact(spark, *once) == once
    assert scan(spark, *once) == [[]]


def test_digits_inside_an_address_stay_with_it(spark):
    assert redact(spark, "to 9876543210@mail.example.com!") == ["to [USER_EMAIL]!"]


def test_token_stripping_hides_any_bracketed_capitals(spark):
    df = spark.createDataFrame([("[4111111111111111] [USER_EMAIL_1] [x]",)], "t string")
    assert df.select(P.strip_tokens(F.col("t"))).first()[0] == "[] [] [x]"


def test_token_shape(spark):
    df = spark.createDataFrame([("[USER_EMAIL_1]",), ("[ADDRESS_12]",), ("[A1_1]",), ("x[CVV_1]",), (None,)], "t string")
    assert [r[0] for r in df.select(P.is_token(F.col("t"))).collect()] == [True, True, False, False, None]


def test_hints_never_show_more_than_allowed(spark):
    df = spark.createDataFrame([("email", "abcdef"), ("ssn", "123-45-6789"), ("credit_card", "4111111111111111"),
                                ("national_id", "234567890123"), ("password", "secret")], "k string, v string")
    hints = [r[0] for r in df.select(P.audit_hint(F.col("k"), F.col("v"))).collect()]
    assert hints == ["abc***", "***", "4111****", "23***", "se***"]


def test_leaks_are_counted_as_they_are_found(spark):
    rng = random.Random(9)
    parts = ["4111 1111 1111 1111", "4111111111111111", "9876543210", "+91 9876543210", "987-65-4321", "1234 5678 9012", "1234 5678 9012", "1990-01-31",
             "555 123 4567", "a@b.co", "é", "x", "_", '"', ", ", " ", "-", "+", "\n", "[USER_EMAIL_1]", "[4111]", "12", "word", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [None, "", *parts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole = df.select("i", F.size(P.scan_text(P.strip_tokens(F.col("t")))).alias("want"))
    rows = P.count_leaks(df, "t", "n").join(whole, "i").collect()
    assert len(rows) == len(texts) and [(r.i, r.t) for r in rows if r.n != r.want] == [] and sum(r.n for r in rows) > 1000
    # what patterns search at every place is what lies around the numbers
    assert spark.createDataFrame([("words " * 50 + "no: 1234567890, x" + " words" * 50,)], "t string").select(
        F.length(P.around_numbers(F.col("t")))).first()[0] < 350

import random
import re

from pyspark.sql import functions as F

from veilspark.operators import rules as R


def _first(texts, rules):
    out = {}
    for i, t in texts:
        hits = [(p, x) for p, x in rules if x is not None and t is not None and re.search(x, t)]
        if hits:
            out[i] = min(hits)
    return out


def _found(spark, texts, rules):
    df = spark.createDataFrame(texts, "id long, t string").withColumn("run", F.lit("clash"))
    table = spark.createDataFrame(rules, "priority int, pattern string")
    return {r.id: (r.rule.priority, r.rule.pattern) for r in R.first_matches(df, "t", table).collect()}


def test_required_runs_occur_in_every_match():
    rnd = random.Random(2)
    atoms = ["ab", "cd", "e", "f?", "g*", "h+", "[ij]", "(?:kl|m)", r"\.", r"\d", "n{2}", "x{0,2}", "."]
    texts = ["".join(rnd.choice("abcdefghijklmn.1xAB") for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    for _ in range(300):
        pattern = "(?i)" + "|".join("".join(rnd.choice(atoms) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 3)))
        runs = R.required(pattern)
        for t in texts[:400]:
            if re.search(pattern, t):
                assert any(r in t.lower() for r in runs), (pattern, runs, t)


def test_many_rules_against_trying_all(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    rules = [(i, "(?i)" + rnd.choice([w, rf"{w}\s+{rnd.choice(words)}", rf"\b{w}\b|{rnd.choice(words)}$", rf"[ab]{w}"])) for i, w in enumerate(words)]
    rules += [(1000, r"\d+"), (7, "zz"), (7, "yy"), (3, None), (2000, r"q\.r")]
    texts = [(i, " ".join(rnd.choices([*words, "zz yy", "12", "Q.R", "ABCD"], k=rnd.randint(0, 4)))) for i in range(300)] + [(998, None), (999, "")]
    assert _found(spark, texts, [r for r in rules if r[0] != 3]) == _first(texts, [r for r in rules if r[0] != 3])


def test_repeated_rows_and_empty_tables(spark):
    assert _found(spark, [], [(1, "a")]) == {} and _found(spark, [(1, "a")], []) == {}
    df = spark.createDataFrame([(None, "abc"), (None, "abc")], "id long, t string")
    assert R.first_matches(df, "t", spark.createDataFrame([(1, "b")], "priority int, pattern string")).count() == 2


def test_rules_of_one_word_are_indexed_by_their_numbers(spark):
    rules = [(i, rf"(?i)(?:no|serial)\s*ref{i}\b|order-{i}", "x") for i in range(1000, 3000)]
    index = R.rule_index(spark.createDataFrame(rules, "priority int, pattern string, pii_type string"))
    assert index.count() == 4000
    assert index.groupBy("run").count().agg({"count": "max"}).first()[0] < 400  # all 2000 under "ord" and "ref" before
    texts = spark.createDataFrame([(1, "ORDER-1234 x"), (2, "ORDER-1234 x"), (3, "no ref2999"), (4, "order reference"), (5, None)], "at int, t string")
    found = R.first_matches(texts, "t", spark.createDataFrame(rules, "priority int, pattern string, pii_type string"))
    assert sorted((r.at, r.rule.priority) for r in found.collect()) == [(1, 1234), (2, 1234), (3, 2999)]

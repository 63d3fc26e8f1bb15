"""Rules kept as a table: contexts meet them through an index of the literals that their patterns require.

A text can only match a pattern if it holds, for one branch of the pattern's top-level
alternation, every plain run of characters of that branch. Each branch is indexed by three
characters of its longest run, those that the fewest rules share; a distinct context gives its
runs of three, two and one characters, and only where both are equal is the pattern tried. Rules
of any number so cost a context a few lookups and the patterns that may match; none of them
reaches the driver.

A pattern with a branch without plain characters (``\\d+``, ``[ab]x*``) can match anywhere;
it stands under the empty run, which every context has, so such rules are tried everywhere.
A null pattern matches nothing; of equal priorities the rule with the least pattern wins.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.session import materialise, ship_package

RUN = 3
_FLAGS = re.compile(r"\(\?([a-zA-Z]*)\)")


def _after_class(p: str, i: int) -> int:
    """The place after the character class that begins at ``i``; Java's may be nested."""
    depth = 0
    while i < len(p):
        if p[i] == "\\":
            i += 1
        elif p[i] == "[":
            depth += 1
            i += p[i + 1: i + 2] == "^"
            i += p[i + 1: i + 2] == "]"
        elif p[i] == "]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return i


def _after_group(p: str, i: int) -> int:
    depth = 0
    while i < len(p):
        if p[i] == "\\":
            i += 2
            continue
        if p[i] == "[":
            i = _after_class(p, i)
            continue
        depth += (p[i] == "(") - (p[i] == ")")
        i += 1
        if not depth:
            return i
    return i


def required(pattern: str) -> list[str]:
    """For each top-level branch its longest run of plain characters, in lower case; '' for a branch without one."""
    if r"\Q" in pattern:
        return [""]
    while m := _FLAGS.match(pattern):
        if "x" in m[1]:  # white space and comments mean nothing there
            return [""]
        pattern = pattern[m.end():]
    for opening in ("(?:", "("):
        if pattern.startswith(opening) and (opening == "(?:" or pattern[1:2] != "?") and _after_group(pattern, 0) == len(pattern):
            return required(pattern[len(opening): -1])
    branches, runs, run, i = [], [], "", 0
    while i <= len(pattern):
        c = pattern[i: i + 1]
        if c == "\\" and not pattern[i + 1: i + 2].isalnum():
            run += pattern[i + 1: i + 2]
            i += 2
            continue
        if c and c not in "\\[(|.^$*?+{":
            run += c
            i += 1
            continue
        if c in ("*", "?", "{"):
            run = run[:-1]  # may be missing
        runs.append(run)
        run = ""
        if c in ("|", ""):
            branches.append(max(runs, key=len).lower())
            runs = []
        if c == "[":
            i = _after_class(pattern, i)
        elif c == "(":
            i = _after_group(pattern, i)
        elif c == "{":
            i = pattern.find("}", i) + 1 or len(pattern)
        elif c == "\\":
            brace = pattern[i + 2: i + 3] == "{"  # \p{Alpha}
            i = pattern.find("}", i) + 1 or len(pattern) if brace else i + 2
        else:
            i += 1
    return branches


def rule_index(rules: DataFrame) -> DataFrame:
    """``rules`` with ``run``, once per branch of the pattern: of the runs of its literal the one that the fewest rules share.

    Rules made from one word and a number so meet in the numbers, not in the word that all of them have.
    """
    ship_package(rules.sparkSession)
    known = rules.where("pattern IS NOT NULL")
    at = known.columns.index("pattern")
    schema = known.withColumn("_literal", F.lit(None).cast("string")).schema

    def run(batches):
        for batch in batches:
            literals = [sorted(set(required(p))) for p in batch.column(at).to_pylist()]
            rows = pa.array([i for i, found in enumerate(literals) for _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(rows) for c in batch.columns], pa.array([x for found in literals for x in found], pa.string())], names=schema.names
            )

    branches = materialise(known.mapInArrow(run, schema), "rule-branches")
    literal, n = F.col("_literal"), F.length("_literal")
    cut = F.transform(F.sequence(F.lit(1), n - (RUN - 1)), lambda i: F.substring(literal, i, F.lit(RUN)))
    plain = F.filter(cut, lambda r: F.rlike(r, F.lit(r"^[\x00-\x7F]+$")))  # lower case depends on the place for others
    runs = F.when(n <= RUN, F.array(literal)).when(F.size(plain) > 0, F.array_distinct(plain)).otherwise(F.array(F.substring(literal, 1, RUN)))
    pieces = branches.groupBy("_literal").agg(F.count(F.lit(1)).alias("_n")).select("_literal", "_n", F.explode(runs).alias("run"))
    shared = pieces.groupBy("run").agg(F.sum("_n").alias("_shared"))
    best = pieces.join(shared, "run").groupBy("_literal").agg(F.min_by("run", F.struct("_shared", "run")).alias("run"))
    return branches.join(best, "_literal").select(*rules.columns, "run")


def first_matches(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """The rows of ``texts`` that match a rule, with ``rule``: the matching row of ``rules`` of least priority.

    ``rules``: priority, pattern and any other columns. Each distinct text meets the rules once, as the contexts of a form
    recur on every page that shows it. The index is joined as its measured size asks: broadcast if it is small, else
    shuffled by the run.
    """
    index = materialise(rule_index(rules), "rule-index")
    sizes = sorted(r[0] for r in index.select(F.length("run")).distinct().collect())  # of 0, 1, 2 and 3
    pieces = [
        F.regexp_extract_all(F.lower(F.col("_text")), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) if n else F.array(F.lit("")) for n in sizes
    ]
    distinct = texts.select(F.col(text).alias("_text")).distinct()
    meet = distinct.select("_text", F.explode(F.array_distinct(F.concat(*pieces) if pieces else F.array().cast("array<string>"))).alias("run"))
    tried = meet.join(index, "run").where(F.rlike(F.col("_text"), F.col("pattern")))
    named = F.struct(*[F.col(c) for c in rules.columns])
    best = tried.groupBy("_text").agg(F.min_by(named, F.struct("priority", "pattern")).alias("rule"))
    found = materialise(best, "rule-matches")
    return texts.join(found, F.col(text) == F.col("_text")).drop("_text")

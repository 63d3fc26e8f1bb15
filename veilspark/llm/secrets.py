"""Secret scans with an incremental ledger of blobs.

Every version of a path is addressed by the digest of its content. The ledger
remembers which (blob, rule version) pairs were scanned and what was found; a
run scans only unseen pairs, then joins the findings back to every path. The
work is native expressions: a guard pattern finds texts worth a second look, a
replacement wraps each match in two markers, and splitting at the markers gives
match and gap lengths, whose running sum is the position.

Results for odd input: a null text counts as empty and has no findings; a path
with a null id is kept; repeated rows each get their findings; an empty table
gives no rows; texts of any length are scanned whole. Markers that occur in a
text are first replaced by another control character, which no rule matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm.common import sha256_hex, text_or_empty
from veilspark.session import materialise, shared_dir

_OPEN, _CLOSE, _PLAIN = "\u0001", "\u0002", "\u0003"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    guard: str
    base: bool = False


# Kinds, patterns and least lengths of the result format.
RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
        r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 12, r"""(?:[DdNnYy]|[Ee][Tt])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""", base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}", base=True),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, r"eyJ[A-Za-z0-9_-]{10}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_[A-Za-z0-9]{36}"),
)
RULE_VERSION = "2"


def findings(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob, kind, rank, base, start, end of every match in ``blobs`` (blob, text); code points, end exclusive."""
    plain = F.translate("text", _OPEN + _CLOSE, _PLAIN * 2)
    hit = F.col("text").rlike("|".join(f"(?:{r.guard})" for r in rules))
    likely = blobs.where(hit).select("blob", plain.alias("text"))

    def parts(rank: int, r: Rule):
        marked = F.regexp_replace("text", r.pattern, f"{_OPEN}$0{_CLOSE}")
        cut = F.transform(
            F.split(marked, f"[{_OPEN}{_CLOSE}]"),
            lambda p, i: F.struct(
                F.length(p).cast("long").alias("n"),
                ((i % 2 == 1) & (F.length(F.regexp_extract(p, r.pattern, r.group)) >= r.least)).alias("ok"),
            ),
        )
        return F.when(
            F.col("text").rlike(r.guard),
            F.struct(F.lit(rank).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.base).alias("base"),
                     cut.alias("parts")),
        )

    per_rule = likely.select(
        "blob", F.explode(F.array_compact(F.array(*[parts(i, r) for i, r in enumerate(rules)]))).alias("r")
    )
    pieces = per_rule.select("blob", "r.rank", "r.kind", "r.base", F.posexplode("r.parts").alias("pos", "p"))
    upto = W.partitionBy("blob", "rank").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return (
        pieces.select("blob", "rank", "kind", "base", "p.ok", "p.n", F.sum("p.n").over(upto).alias("end"))
        .where("ok").select("blob", "kind", "rank", "base", (F.col("end") - F.col("n")).alias("start"), "end")
    )


@dataclass(frozen=True)
class Ledger:
    """Two append-only tables below ``path``: ``scanned`` (blob, rules) and ``findings``; one folder per run."""

    spark: SparkSession
    path: str

    SCANNED = "blob string, rules string"
    FOUND = "blob string, kind string, rank int, base boolean, start long, end long, rules string"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").distinct()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing has been scanned yet

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED)

    def found(self) -> DataFrame:
        return self._read("findings", self.FOUND)

    def add(self, blobs: DataFrame, found: DataFrame) -> None:
        """Findings first: a run that dies in between is scanned again, and repeated findings are equal rows."""
        found.write.mode("append").parquet(f"{self.path}/findings")
        blobs.write.mode("append").parquet(f"{self.path}/scanned")


def addressed(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, blob of every version."""
    return versions.select(F.col(path_col).alias("path"), sha256_hex(text_or_empty(text_col)).alias("blob"))


def scan(versions: DataFrame, ledger: Ledger, path_col: str = "doc_id", text_col: str = "text",
         rules: Sequence[Rule] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Bring the ledger up to date; returns path, blob of every version (written once)."""
    paths = materialise(addressed(versions, path_col, text_col), "ledger-paths")
    seen = ledger.scanned().where(F.col("rules") == rule_version).select("blob")
    unseen = materialise(
        paths.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left_anti"), "ledger-unseen"
    )
    text = text_or_empty(text_col)
    full = versions.select(F.col(path_col).alias("path"), text.alias("text"), sha256_hex(text).alias("blob"))
    one = full.alias("f").join(
        unseen.alias("u"), F.col("f.path").eqNullSafe(F.col("u.path")) & (F.col("f.blob") == F.col("u.blob"))
    ).select("f.blob", "f.text")
    ledger.add(
        unseen.select("blob", F.lit(rule_version).alias("rules")),
        findings(one, rules).withColumn("rules", F.lit(rule_version)),
    )
    return paths


_SPANS = "array<struct<start:long,rank:int,end:long,kind:string,base:boolean>>"


def _joined(spans: str, keep) -> F.Column:
    return F.array_join(
        F.transform(F.filter(spans, keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def per_path(paths: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES,
             rule_version: str = RULE_VERSION) -> DataFrame:
    """One row per path and version: path, blob, spans (array of kind, start, end, base by start, then rule)."""
    # Written, so that the join has a plain table on either side: small, it is broadcast; else a blob with very many
    # paths is split over tasks.
    spans = materialise(
        ledger.found().where(F.col("rules") == rule_version).groupBy("blob")
        .agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "base"))).alias("spans")),
        "ledger-spans",
    )
    return paths.join(spans, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")
    )


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def summary(found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans as text."""
    kinds = [r.kind for r in rules if r.base]
    return found.select(
        "path",
        *[F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds],
        sha256_hex(_joined("spans", lambda s: s["base"])).alias("base_sha256"),
        _joined("spans", lambda s: F.lit(True)).alias("spans"),
    )


def fresh_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark, shared_dir(spark, "ledger"))

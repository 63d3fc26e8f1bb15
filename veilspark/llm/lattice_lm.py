"""Language-model scores from a subword lattice.

The vocabulary is given and its scores are the starting weights. Word counts of
all training documents are gathered by grouped aggregation, and a few rounds of
expectation over the lattices of the distinct words fit the piece weights, so
each distinct word is segmented once per round. A word's probability is its
marginal over all segmentations, the word as a piece of its own among them: the
vocabulary's segmentations share the weight of unseen words (words seen once, per
token, the Good-Turing estimate), whole words have the rest by their counts. A
document's probability is the product over its words and the end.

Scoring looks up frequent words in a table of bounded size; all other words of a
document are joined with the full word table, so no word is left out.

Results for odd input: null and empty texts have the end alone; a null id counts
as the empty string when documents are held out; repeated rows each count and
each give a row; without training rows every word has the same base score; very
long texts count whole, and a very long word (text without spaces is one) takes
time in proportion to its length; an empty table gives no rows; other columns are
not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.lattice import Lattice, Vocabulary
from veilspark.session import materialise, ship_package

ROUNDS = 3
PRIOR = 0.01
"""Added to the expected uses of each piece."""
FREQUENT, FREQUENT_BYTES = 100_000, 64
"""Words that every task holds: so many at most, each of so many bytes at most (below 20 MB in all)."""
TOGETHER = 60_000
"""Words whose lattices are worked on at once."""
FLUSH = 300_000
"""Distinct words that a task counts before it hands them on."""

_LN10 = float(np.log(10))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of words, joined to larger ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def held_out(id_col: str, parts: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == 0


def _words(text: str | None) -> list[bytes]:
    """Bytes lower-case ASCII only, and split at exactly the ASCII white space."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, text_col: str, training: Column) -> DataFrame:
    """word, c (in training rows), n (in all rows) of every distinct word."""

    def run(batches):
        c: dict[bytes, int] = {}
        n: dict[bytes, int] = {}

        def flush():
            both = list(c.keys() | n.keys())
            row = [pa.array(both, pa.binary()), pa.array([c.get(w, 0) for w in both], pa.int64()),
                   pa.array([c.get(w, 0) + n.get(w, 0) for w in both], pa.int64())]
            c.clear()
            n.clear()
            return pa.RecordBatch.from_arrays(row, names=["word", "c", "n"])

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                into = c if train else n
                get = into.get
                for w in _words(text.as_py()):
                    into[w] = get(w, 0) + 1
                if len(c) + len(n) > FLUSH:
                    yield flush()
        if c or n:
            yield flush()

    rows = docs.select(F.col(text_col).alias("text"), training.alias("train"))
    counted = rows.mapInArrow(run, "word binary, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(counts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of all pieces; each round sends one row per piece and task, and the driver holds one vector.

    Every distinct training word counts once, as the pieces speak for words not seen before.
    """
    log_p = vocabulary.log_start
    trained = counts.where("c > 0").select("word")
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast((vocabulary, log_p))

        def run(batches, shared=shared):
            lattice = Lattice(*shared.value)
            total = np.zeros(len(shared.value[1]))
            for batch in _together(batches):
                total += lattice.expected(batch.column(0).to_pylist(), np.ones(len(batch)))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

        sums = trained.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.full(len(log_p), PRIOR)
        for piece, n in sums.collect():  # bounded by the vocabulary
            uses[piece] += n
        uses[vocabulary.end] += 1
        log_p = np.log(uses / uses.sum())
    return log_p


@dataclass(frozen=True)
class Model:
    """``words``: word, n, c and score (log10 probability) of each word; tokens and types of the training rows."""

    words: DataFrame
    tokens: int
    types: int
    ends: int
    end_score: float

    def base(self, c: Column) -> Column:
        return F.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def train(docs: DataFrame, vocabulary_path: str, training: Column, text_col: str = "text",
          rounds: int = ROUNDS) -> Model:
    """Count, fit, and score every distinct word of ``docs`` once."""
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = Vocabulary.load(vocabulary_path)
    counts = materialise(word_counts(docs, text_col, training), "lm-counts")
    ends = docs.where(training).count()
    words, types, once = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)
    ).first()
    tokens = words + ends
    unseen = (once + 1) / (tokens + 2)
    log_p = fit(counts, vocabulary, rounds)
    shared = spark.sparkContext.broadcast((vocabulary, log_p))

    def mixed(c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            whole = np.log((1 - unseen) * c / max(tokens, 1))
        return np.logaddexp(whole, np.log(unseen) + lattice) / _LN10

    def run(batches):
        lattice = Lattice(*shared.value)
        for batch in _together(batches):
            found = mixed(batch.column(1).to_numpy(), lattice.log10(batch.column(0).to_pylist()) * _LN10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["word", "c", "n", "score"])

    scored = materialise(counts.mapInArrow(run, "word binary, c long, n long, score double"), "lm-words")
    end = mixed(np.array([ends]), np.array([log_p[vocabulary.end]]))
    return Model(scored, tokens, types + (ends > 0), ends, float(end[0]))


def frequent(table: DataFrame) -> DataFrame:
    """The most frequent words of ``table`` (word, n), at most FREQUENT of them, none above FREQUENT_BYTES.

    Sixteen levels for each doubling of the count are counted first, so only the
    words at or above the chosen level travel, however many tasks there are.
    """
    short = table.where(F.octet_length("word") <= FREQUENT_BYTES).withColumn("level", F.floor(16 * F.log2("n")))
    least, seen = None, 0
    for level, n in sorted(short.groupBy("level").count().collect(), reverse=True):
        seen += n
        if seen > FREQUENT:
            break
        least = level
    return short.where(F.lit(False) if least is None else F.col("level") >= least).drop("level")


def score(docs: DataFrame, model: Model, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    table = model.words.select("word", "n", (F.col("c") > 0).cast("long").alias("known"),
                               model.base(F.col("c")).alias("base"), "score")
    top = frequent(table).drop("n").toPandas()
    shared = spark.sparkContext.broadcast(
        (dict(zip(map(bytes, top["word"]), range(len(top)), strict=True)), top[["known", "base", "score"]].to_numpy(float))
    )
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       held.alias("held_out"), F.col(text_col).alias("text"))
    schema = rows.select(
        "row", "id", "held_out", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("known"),
        F.lit(0.0).alias("base"), F.lit(0.0).alias("score"),
        F.lit(None).cast("array<struct<word:binary,n:bigint>>").alias("rest"),
    ).schema
    rest_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches):
        number, values = shared.value
        get = number.get
        for batch in batches:
            sums, sizes, rest = np.zeros((len(batch), 3)), [], []
            for i, text in enumerate(batch.column(3)):
                words = _words(text.as_py())
                at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                sums[i] = values[at[at >= 0]].sum(axis=0)
                sizes.append(len(words))
                left: dict[bytes, int] = {}
                for k in np.flatnonzero(at < 0):
                    left[words[k]] = left.get(words[k], 0) + 1
                rest.append([{"word": w, "n": n} for w, n in left.items()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(sums[:, 0].astype(np.int64)),
                 pa.array(sums[:, 1]), pa.array(sums[:, 2]), pa.array(rest, rest_type)], names=schema.names,
            )

    partly = materialise(rows.mapInArrow(run, schema), "lm-partly")
    others = (
        partly.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
        .join(table.drop("n"), "word").groupBy("row")
        .agg(*[F.sum(F.col(c) * F.col("times")).alias(f"more_{c}") for c in ("known", "base", "score")])
    )
    end_base = model.base(F.lit(model.ends))
    plus = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("known", "base", "score")}
    return partly.drop("rest").join(others, "row", "left").select(
        "id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"),
        (plus["known"] + int(model.ends > 0)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (plus["base"] + end_base).alias("base_score"), (plus["score"] + model.end_score).alias("score"),
    )

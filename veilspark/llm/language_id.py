"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are added in log space:
* the text, by letter trigrams of each language (a conditional model per language,
  and one for text in no known language);
* the language that the markup declares, by how often each language is declared
  as which, estimated from the texts;
* the address, by priors from grouped counts: all rows, suffix, registered domain
  and host, each level smoothed towards the one above.

The text model is fitted on a stratified sample of labelled rows, about so many
per language; everything else is counted over all rows.

Results for odd input: null, empty and letterless texts leave the decision to the
other evidence; a null or unknown declaration, suffix or host says nothing and
its level of the prior is that above; a null id is kept; repeated rows each count
and each give a row; without labelled rows every language is equally likely; an
empty table gives no rows; a very long text is read whole, in a chunk of its own; other
columns pass through ``identify``, but for those named like its results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.session import materialise, ship_package

UNKNOWN = "und"
PER_LANGUAGE = 2_000
"""Labelled rows per language that the text model is fitted on."""
MOST_LANGUAGES = 64
"""Languages of the text model: the most frequent labels (1 MB each); rows with any other label are not fitted on."""
SMOOTHING = 5.0
"""Rows that the level above is worth at each level of the prior."""
EVIDENCE_LETTERS = 200
"""Letters after which a text's weight stops growing, as its trigrams are not independent."""
ACCEPT = 0.5
CHUNK_BYTES = 1 << 20

RESULTS = ("lang", "posterior", "text_lang", "letters", "accepted")

_CLASS = np.zeros(256, np.uint8)  # a to z as 1 to 26, other ASCII as 0, bytes beyond ASCII as they are
for _b in range(26):
    _CLASS[0x41 + _b] = _CLASS[0x61 + _b] = _b + 1
_CLASS[0x80:] = np.arange(0x80, 0x100)
_BITS = 17
_ALPHABET, _SMALL = 60, 0.05  # letters that may follow a context, and what each counts unseen


def _features(column: pa.Array):
    """Per place: its trigram's slot, its context's slot and its text; per text: letters. Only places of letters."""
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0]: bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    code = _CLASS[data].astype(np.uint32)
    padded = np.concatenate([np.zeros(2, np.uint32), code])
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    one, two = padded[1:-1].copy(), padded[:-2].copy()  # the bytes before
    one[starts] = 0
    two[starts] = 0
    second = starts + 1
    two[second[second < len(two)]] = 0
    two[one == 0] = 0  # what is before a gap says nothing
    at = np.flatnonzero(code)
    context = (two[at] << np.uint32(8)) | one[at]
    slot = ((((context << np.uint32(8)) | code[at]) * np.uint32(2654435761)) >> np.uint32(32 - _BITS)).astype(np.int64)
    text = np.searchsorted(bounds, at, side="right") - 1
    lead = (code[at] < 0x80) | (code[at] >= 0xC0)
    return slot, context.astype(np.int64), text, np.bincount(text[lead], minlength=len(column))


@dataclass(frozen=True)
class TextModel:
    """Log weights by language, the unknown one last: of each trigram slot and of each two-letter context."""

    languages: tuple[str, ...]
    grams: np.ndarray
    contexts: np.ndarray

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts x languages: log likelihood of the letters; and the number of letters."""
        slot, context, text, letters = _features(column)
        out = np.empty((len(column), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(text, self.grams[k][slot] - self.contexts[k][context], len(column))
        return out, letters


def subtag(label: str | Column) -> Column:
    """The language of a label or declaration: its primary subtag in lower case ("en" of "en-US", "fil" of "fil")."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,8})(?:[-_].*)?$", 1), F.lit(""))


def fit_text(docs: DataFrame, label: str, text_col: str, per_language: int = PER_LANGUAGE) -> TextModel:
    """Trigram counts by task and language, summed by Spark; the driver gets one bounded vector per language."""
    ship_package(docs.sparkSession)
    labelled = docs.select(subtag(F.col(label)).alias("label"), F.col(text_col).alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LANGUAGES)
    sizes = {r[0]: r[1] for r in sizes.collect() if r[0] != UNKNOWN}
    languages = sorted(sizes)
    sample = labelled.sampleBy("label", {k: min(1.0, per_language / n) for k, n in sizes.items()}, seed=7)

    def run(batches):
        total: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            slot, context, text, _ = _features(batch.column(1))
            names = np.array(batch.column(0).to_pylist(), object)
            for name in set(names):
                mine = np.isin(text, np.flatnonzero(names == name))
                for is_context, x in ((False, slot[mine]), (True, context[mine])):
                    n = np.bincount(x, minlength=1 << _BITS)
                    total[name, is_context] = total.get((name, is_context), 0) + n
        for (name, is_context), n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen)), pa.array([is_context] * len(seen)), pa.array(seen), pa.array(n[seen])],
                names=["label", "context", "slot", "n"],
            )

    counted = sample.mapInArrow(run, "label string, context boolean, slot long, n long")
    rows = counted.groupBy("label", "context", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, len(languages) + 1, 1 << _BITS))
    for k, name in enumerate(languages):
        for c in (0, 1):
            part = rows[(rows["label"] == name) & (rows["context"] == bool(c))]
            counts[c, k, part["slot"].to_numpy(int)] = part["n"].to_numpy(float)
    grams = np.log(counts[0] + _SMALL)
    contexts = np.log(counts[1] + _SMALL * _ALPHABET)
    # Text in no known language: all letters alike, and a little likelier than a model that never saw a context.
    grams[-1], contexts[-1] = 0, np.log(0.8 * _ALPHABET)
    return TextModel((*languages, UNKNOWN), grams.astype(np.float32), contexts.astype(np.float32))


def text_evidence(docs: DataFrame, model: TextModel, text_col: str) -> DataFrame:
    """``docs`` without the text, with ``evidence`` (log likelihood per language, tempered) and ``letters``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    kept = docs.drop(text_col)
    schema = kept.select(
        "*", F.lit(None).cast("array<double>").alias("evidence"), F.lit(0).cast("long").alias("letters")
    ).schema

    def run(batches):
        from veilspark.llm.wordbytes import shards

        model = shared.value
        for part in shards(batches, text_col, CHUNK_BYTES):
            texts = part.column(at)
            texts = texts.fill_null("") if texts.null_count else texts
            score, letters = model.score(texts)
            score *= (np.minimum(letters, EVIDENCE_LETTERS) / np.maximum(letters, 1))[:, None]
            flat = pa.array(score.ravel())
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, flat.__len__() + 1, score.shape[1], dtype=np.int32)), flat
            )
            arrays = [part.column(i) for i in range(part.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*arrays, lists, pa.array(letters)], names=schema.names)

    return docs.mapInArrow(run, schema)


def suffix_of(host: Column) -> Column:
    """The part of a host name after its last dot."""
    return F.regexp_extract(F.lower(host), r"\.([a-z][a-z0-9-]*)$", 1)


def domain_of(host: Column) -> Column:
    """The last two labels of a host name, three where the last two are like "co.uk" or "com.br"; or the name itself."""
    return F.regexp_extract(F.lower(host), r"([^.]+\.(?:ac|co|com|edu|gov|net|or|org)\.[a-z]{2}|[^.]+\.[^.]+|[^.]+)$", 1)


def _argmax(values: Column, languages: Sequence[str]) -> Column:
    names = F.array(*[F.lit(x) for x in languages])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def _shares(rows: DataFrame, key: str, languages: Sequence[str]) -> DataFrame:
    """Per value of ``key``: how many rows' texts speak for each language; partial sums, so a hot key is no burden."""
    counts = [F.coalesce(F.sum((F.col("said") == x).cast("double")), F.lit(0.0)) for x in languages]
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.array(*counts).alias(f"n_{key}"))


def _smoothed(counts: Column, above: Column) -> Column:
    """Dirichlet smoothing of a level's counts by the level above."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    mixed = F.zip_with(counts, above, lambda n, p: (n + SMOOTHING * p) / (total + SMOOTHING))
    return F.when(counts.isNull(), above).otherwise(mixed)


def identify(docs: DataFrame, model: TextModel, text_col: str = "text", declared_col: str | None = None,
             host_col: str | None = None) -> DataFrame:
    """``docs`` without the text, with lang, posterior, text_lang, letters and accepted.

    ``accepted`` is false for rows that are most likely in no known language, or
    whose best language has a posterior below one half. A column of ``docs`` named
    like one of these five, in any case, gives way to it.
    """
    languages = model.languages
    keys = {}
    if declared_col:
        keys["declared"] = subtag(F.col(declared_col))
    if host_col:
        host = F.lower(F.col(host_col))
        keys |= {"suffix": suffix_of(host), "domain": domain_of(host), "host": host}
    # All other columns travel in one, so that no name can clash with those made here.
    keep = [c for c in docs.columns if c != text_col and c.lower() not in RESULTS]
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    narrow = docs.select(kept.alias("row"), F.col(text_col).alias("text"), *[F.nullif(v, F.lit("")).alias(k) for k, v in keys.items()])
    rows = text_evidence(narrow, model, "text")
    # Texts of a few letters speak for nothing on their own, so they don't shape the priors.
    said = F.when(F.col("letters") >= 20, _argmax(F.col("evidence"), languages))
    rows = materialise(rows.withColumn("said", said), "language-evidence")
    k = len(languages)
    counts = [F.coalesce(F.sum((F.col("said") == x).cast("double")), F.lit(0.0)) for x in languages]
    overall = rows.agg(*counts).first()
    total = sum(overall)
    prior = F.array(*[F.lit((n + SMOOTHING / k) / (total + SMOOTHING)) for n in overall])
    joined, level = rows, prior
    for key in keys:
        # Rows without the key get one of their own each, so that they don't meet in one task.
        own = F.concat(F.lit("\0"), F.xxhash64("evidence").cast("string"))
        shares = _shares(rows, key, languages).withColumnRenamed(key, "at")
        joined = joined.withColumn("at", F.coalesce(key, own)).join(shares, "at", "left").drop("at")
        if key != "declared":
            level = _smoothed(F.col(f"n_{key}"), level)
    joined = joined.withColumn("prior", level)
    total_log = F.zip_with("evidence", F.transform("prior", lambda p: F.log(p)), lambda x, y: x + y)
    if declared_col:
        # P(declared | language) up to a factor that all languages share.
        share = F.zip_with(_smoothed(F.col("n_declared"), prior), prior, lambda s, p: F.log(s / p))
        total_log = F.zip_with(total_log, share, lambda x, y: x + y)
    joined = joined.withColumn("logs", total_log)
    top = F.array_max("logs")
    joined = joined.withColumn(
        "posterior", 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    ).withColumn("lang", _argmax(F.col("logs"), languages))
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in keep], "lang", "posterior", F.col("said").alias("text_lang"), "letters",
        ((F.col("lang") != UNKNOWN) & (F.col("posterior") >= ACCEPT)).alias("accepted"),
    )

"""Corpus pipeline: language, exact copies, near copies, benchmark passages, token ids.

Each stage takes the documents that its predecessor kept. All but the last return
the columns of their input; the last returns what was encoded, and its digests.
Null texts count as empty, null ids are kept apart by their texts, repeated rows count
one by one, texts of any length are read whole, other columns (also ones named like a
result of a stage) come out as they went in, and empty input passes through every stage
as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from veilspark.llm import decontaminate, exact_dedup, language_id, near_dedup, op9_queries
from veilspark.llm.common import sha256_hex, text_or_empty
from veilspark.session import materialise, shared_dir

ORACLE_SQL = None
"""The text model, the bands and the pieces have no SQL; the tests run each stage against brute force."""


def _key():
    """Says which text a row has, for tables that repeat an id."""
    return sha256_hex(text_or_empty("text"))


def _dropping(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by id and key.

    A merge join at every size: its shuffle grows with the input and no side is ever broadcast.
    """
    gone = materialise(gone.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "dropped").hint("merge")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (sha256_hex(text_or_empty(docs["text"])) == gone["gone_key"]), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the label is the declaration, the source is the host."""
    rows = docs.select(F.col("doc_id").alias("id"), _key().alias("key"), "text", F.col("lang").alias("declared"), "source")
    model = language_id.fit_text(rows, "declared", "text")
    found = language_id.identify(rows, model, declared_col="declared", host_col="source")
    return _dropping(docs, found.where(~F.col("accepted")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    found = exact_dedup.dedup(docs, exact_dedup.by_half("doc_id"))
    return _dropping(docs, found.where(~F.col("kept")).withColumnRenamed("text_sha256", "key"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document with the least id."""
    rows = docs.select(F.struct(F.col("doc_id").alias("id"), _key().alias("key")).alias("row"), "text")
    found = near_dedup.join(rows, "row")
    return _dropping(docs, found.where(F.col("id") != F.col("class_id")).select("id.id", "id.key"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    leak = "leak"
    while leak in {c.lower() for c in docs.columns}:
        leak += "_"
    return decontaminate.matches(docs, items, out_col=leak).where(~decontaminate.contaminated(leak)).drop(leak)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding: counts and digests."""
    return op9_queries.digests(docs, public_tokenizers.path(op9_queries.MODEL))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark_passages),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Queries of language identification; tested by held-out accuracy."""

from pyspark.sql import functions as F

from veilspark.llm import language_id
from veilspark.llm.common import table
from veilspark.llm.registry import query

_TAGS = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#a-z0-9]+;"


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    """Documents: the label is the declaration, the source is the host."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").withColumnRenamed("lang", "declared")
    model = language_id.fit_text(docs, "declared", "text")
    found = language_id.identify(docs, model, declared_col="declared", host_col="source")
    return found.withColumnRenamed("accepted", "kept")


@query("page_language")
def page_language(spark, sf_dir):
    """Pages: declaration of the markup, host and suffix of the address; the text model comes from documents."""
    docs = table(spark, sf_dir, "documents", "lang", "text")
    model = language_id.fit_text(docs, "lang", "text")
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html").select(
        "page_id", F.regexp_replace("html", _TAGS, " ").alias("text"),
        F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1).alias("declared"),
        F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1).alias("host"),
    )
    return language_id.identify(pages, model, declared_col="declared", host_col="host").withColumnRenamed("accepted", "kept")

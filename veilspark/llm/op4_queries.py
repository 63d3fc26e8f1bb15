"""Query of exact deduplication and its check SQL."""

from pyspark.sql import functions as F

from veilspark.llm import exact_dedup
from veilspark.llm.common import table
from veilspark.llm.registry import query

SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM h WINDOW w AS (PARTITION BY t)
"""


@query("op4_exact_dedup", SQL)
def op4_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = exact_dedup.dedup(docs, exact_dedup.by_half("doc_id"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")

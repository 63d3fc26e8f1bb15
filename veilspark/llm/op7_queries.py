"""Query of the n-gram Jaccard join; tested against brute force over all pairs."""

from veilspark.llm import near_dedup
from veilspark.llm.common import table
from veilspark.llm.registry import query


@query("op7_jaccard_join")
def op7_jaccard_join(spark, sf_dir):
    return near_dedup.join(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")

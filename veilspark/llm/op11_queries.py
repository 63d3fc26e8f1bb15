"""Query of SimHash near-duplicates; tested against brute force over all pairs."""

from pyspark.sql import functions as F

from veilspark.llm import simhash
from veilspark.llm.common import table
from veilspark.llm.registry import query


@query("op11_simhash")
def op11_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of("fp").alias("fingerprint"), "component_id")

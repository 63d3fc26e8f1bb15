"""Query of embedding whitening; tested against a direct computation."""

from pyspark.sql import functions as F

from veilspark.llm import whitening
from veilspark.llm.common import table
from veilspark.llm.registry import query


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumnRenamed("id", "vec_id")

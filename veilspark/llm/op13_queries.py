"""Query of spelling variants; tested against brute force."""

from veilspark.llm import spelling
from veilspark.llm.common import table
from veilspark.llm.registry import query


@query("op13_spelling")
def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents", "doc_id", "text"))

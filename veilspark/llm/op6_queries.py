"""Query of language-model scoring; tested against brute force over all segmentations."""

import public_tokenizers

from veilspark.llm import lattice_lm
from veilspark.llm.common import table
from veilspark.llm.registry import query

VOCABULARY = "piece_bpe_32k.model"


@query("op6_lattice_score")
def op6_lattice_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = lattice_lm.held_out("doc_id")
    model = lattice_lm.train(docs, public_tokenizers.path(VOCABULARY), ~held)
    return lattice_lm.score(docs, model, held).withColumnRenamed("id", "doc_id")

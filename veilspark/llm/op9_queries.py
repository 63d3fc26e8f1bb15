"""Query of SentencePiece encoding and decoding; tested against the library itself."""

import public_tokenizers
from pyspark.sql import functions as F

from veilspark.llm import pieces
from veilspark.llm.common import sha256_hex, table
from veilspark.llm.registry import query

MODEL = "piece_bpe_32k.model"


def digests(docs, model: str):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents."""
    coded = pieces.decode(pieces.encode(docs.select("doc_id", "text"), model), model, out="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join("ids", " ")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(MODEL))

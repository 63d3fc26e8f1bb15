"""Query of the token files; tested against the library itself."""

import public_tokenizers

from veilspark.llm import token_files
from veilspark.llm.common import table
from veilspark.llm.registry import query

TOKENIZER = "byte_bpe_50k.json"


@query("op8_token_files")
def op8_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    folder = token_files.encoded_files(docs, public_tokenizers.path(TOKENIZER))
    checked = token_files.checksums(spark, folder)
    out = checked.join(token_files.starts(spark, folder), "place")
    return out.selectExpr("doc AS doc_id", "start", "n_ids AS n_tokens", "crc32 AS ids_crc32")

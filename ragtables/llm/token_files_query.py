"""Query of the token files."""

import public_tokenizers

from ragtables.llm.catalog import query, table
from ragtables.llm.token_files import token_files

VOCABULARY = "byte_bpe_50k.json"


@query("op2_elias_fano_tokens")
def op2(spark, sf_dir):
    rows = token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")

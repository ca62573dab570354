"""Query of encoding and decoding; the vocabulary has no SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from ragtables.llm.catalog import query, table
from ragtables.llm.tree_bpe import decode_ids, encode_texts, read_vocabulary

VOCABULARY = "word_bpe_49k.json"


@query("op11_tree_bpe")
def op11(spark, sf_dir):
    vocabulary = read_vocabulary(public_tokenizers.path(VOCABULARY))
    encoded = encode_texts(table(spark, sf_dir, "documents"), vocabulary)
    return decode_ids(encoded, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))

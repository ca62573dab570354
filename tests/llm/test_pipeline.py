"""The pipeline's rows beside its stages done one after another without Spark's files in between."""

import zlib

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F


def test_pipeline_tokenizes_what_the_stages_keep(spark, sf):
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{sf}/documents.parquet")
    before = None
    for name, stage in pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, sf).cache()
        assert rows.columns == before.columns
        if name != "mix_sources":
            assert rows.count() < before.count() and rows.join(before, rows.columns, "left_anti").count() == 0
    library = Tokenizer.from_file(public_tokenizers.path(pipeline.VOCABULARY))
    want = []
    for r in rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)

"""Physical plans: what reaches the scan, which joins, how many shuffles."""

from pyspark.sql import functions as F

from ragtables.catalog import QUERIES, load
from ragtables.catalog.fixtures import view
from ragtables.operators import embedding, training
from ragtables.sources.tables import scan
from tests.conftest import plan

load()


def test_scan_pushes_filter_and_columns(spark, sf):
    text = plan(scan(spark, f"{sf}/orders.parquet", ["o_orderkey"], F.col("o_orderstatus") == "P"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_existence_guards_are_anti_and_semi_joins(spark, sf):
    chunks, embeddings = view(spark, sf, "v_chunks"), view(spark, sf, "v_embeddings")
    assert "LeftAnti" in plan(embedding.chunks_without_embedding(chunks, embeddings))
    assert "LeftAnti" in plan(QUERIES["bots_available_for_training"](spark, sf))
    assert "LeftSemi" in plan(QUERIES["embeddings_of_source"](spark, sf))


def test_rollup_combines_before_the_shuffle(spark, sf):
    text = plan(training.job_status_rollup(view(spark, sf, "v_jobs").select("job_id"),
                                           view(spark, sf, "v_source_outcomes")))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_text_jobs_need_no_shuffle(spark, sf):
    from ragtables.operators.chunking import chunk_documents
    from ragtables.operators.html_text import extract_text

    assert "Exchange" not in plan(chunk_documents(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")))
    text = plan(extract_text(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")))
    assert "Exchange" not in text and "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_vectors_stay_out_of_joins_that_need_no_vector(spark, sf):
    for name in ("chunks_without_embedding", "distinct_embedded_ids", "embeddings_of_source"):
        assert "embedding:array" not in plan(QUERIES[name](spark, sf)), name


def test_no_cross_joins_and_no_python_in_relational_queries(spark, sf):
    python = ("MapInArrow", "ArrowEvalPython", "FlatMap", "BatchEvalPython")
    for name in ("fk_audit", "unique_audit", "value_audits", "cascade_delete", "set_null_delete", "route_messages",
                 "sources_for_job", "source_file_lookup", "match_by_content_hash", "orphan_uploads", "enqueue_jobs",
                 "dedupe_chunk_inserts", "soft_delete_source", "job_status_rollup", "verify_uploads"):
        text = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert not any(p in text for p in python), name

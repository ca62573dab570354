"""Tables that are published in versions, and marks that are merged on reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtables.catalog import query
from ragtables.catalog.fixtures import view
from ragtables.catalog.training import DOOMED, NOW, _now
from ragtables.operators import cleanup as C
from ragtables.operators import training as D
from ragtables.session import scratch_path
from ragtables.sources.snapshots import Store


def _store(spark, sf):
    """A new store with the chunks and vectors of the test tables in one version."""
    store = Store(spark, scratch_path(spark, "store"))
    store.publish({"chunks": view(spark, sf, "v_chunks"), "vectors": view(spark, sf, "v_embeddings")})
    return store


@query("publish_versions", """
    SELECT 'old' AS seen, document_id, document_id IN (SELECT document_id FROM v_embeddings) AS has_vector
    FROM v_chunks WHERE document_id % 2 = 0
    UNION ALL
    SELECT 'new' AS seen, document_id, document_id IN (SELECT document_id FROM v_embeddings) AS has_vector FROM v_chunks""")
def publish_versions(spark, sf):
    """Two batches; the writer of the second dies once between vectors and chunks, and both are published again."""
    chunks, vectors = view(spark, sf, "v_chunks"), view(spark, sf, "v_embeddings")
    parts = [{"vectors": vectors.filter(F.col("document_id") % 2 == i), "chunks": chunks.filter(F.col("document_id") % 2 == i)} for i in (0, 1)]
    store = Store(spark, scratch_path(spark, "store"))

    def seen(name):
        have = store.read("vectors").select("document_id", F.lit(True).alias("h"))
        return store.read("chunks").join(have, "document_id", "left").select(
            F.lit(name).alias("seen"), "document_id", F.coalesce("h", F.lit(False)).alias("has_vector"))

    store.publish(parts[0], writer="job", batch=0)
    store.stage("vectors", parts[1]["vectors"])  # written, but never named by a version
    old = seen("old")
    for batch in (1, 0, 1):
        store.publish(parts[batch], writer="job", batch=batch)
    return old.unionByName(seen("new"))


DELETED = f"""
    SELECT document_id, is_active, coalesce(CAST(deleted_at AS STRING),
           CASE WHEN source_id IN {DOOMED} THEN '{NOW}' ELSE '' END) AS deleted_at FROM v_chunks"""


def _after_deletion(spark, sf):
    store = _store(spark, sf)
    chunks = store.rows("chunks")
    doomed = chunks.groupBy("source_id").agg(F.min("document_id").alias("m")).filter("m % 2 = 0")
    C.mark_deleted(store, doomed, _now())
    return store


def _shown(rows, *columns):
    return rows.select(*columns, F.coalesce(F.col("deleted_at").cast("string"), F.lit("")).alias("deleted_at"))


@query("soft_delete_marks", DELETED)
def soft_delete_marks(spark, sf):
    """Deletion of sources by one mark each, merged when chunks are read."""
    return _shown(_after_deletion(spark, sf).read("chunks", C.CHUNK_CHANGES), "document_id", "is_active")


@query("soft_delete_compacted", DELETED)
def soft_delete_compacted(spark, sf):
    """The same after a second deletion at a later time and compaction: times that are set stay."""
    store = _after_deletion(spark, sf)
    doomed = store.rows("chunks").groupBy("source_id").agg(F.min("document_id").alias("m")).filter("m % 2 = 0")
    C.mark_deleted(store, doomed, F.lit("2027-01-01 00:00:00").cast("timestamp_ntz"))
    store.compact("chunks", C.CHUNK_CHANGES, share=0.0)
    return _shown(store.read("chunks", C.CHUNK_CHANGES), "document_id", "is_active")


@query("soft_delete_vector_marks", f"""
    SELECT document_id, coalesce(CAST(deleted_at AS STRING),
           CASE WHEN document_id IN (SELECT document_id FROM v_chunks WHERE source_id IN {DOOMED}) THEN '{NOW}'
                ELSE '' END) AS deleted_at FROM v_embeddings""")
def soft_delete_vector_marks(spark, sf):
    return _shown(_after_deletion(spark, sf).read("vectors", C.VECTOR_CHANGES), "document_id")


@query("activation_marks", """
    SELECT document_id, is_active OR document_id IN (SELECT document_id FROM v_embeddings) AS is_active FROM v_chunks""")
def activation_marks(spark, sf):
    """Chunks become active by a mark once their vector is there."""
    store = _store(spark, sf)
    D.mark_active(store, store.rows("vectors"))
    return store.read("chunks", C.CHUNK_CHANGES).select("document_id", "is_active")


@query("queue_marks", """
    SELECT source_id, CASE WHEN source_id IN (SELECT source_id FROM v_job_sources WHERE job_id % 10 = 0)
                           THEN 'queued_for_training' ELSE status END AS status FROM v_sources""")
def queue_marks(spark, sf):
    """Sources that a job takes, marked in a store; those of some jobs are marked twice."""
    store = Store(spark, scratch_path(spark, "store"))
    store.publish({"sources": view(spark, sf, "v_sources")})
    taken = view(spark, sf, "v_job_sources").filter("job_id % 10 = 0")
    D.mark_queued(store, taken)
    D.mark_queued(store, taken.filter("job_id % 20 = 0"))
    return store.read("sources", D.SOURCE_CHANGES).select("source_id", "status")

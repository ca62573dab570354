"""Training sources and jobs, uploads, clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtables.catalog import query
from ragtables.catalog.fixtures import view
from ragtables.functions.names import has_host
from ragtables.operators import cleanup as C
from ragtables.operators import embedding as E
from ragtables.operators import filters as B
from ragtables.operators import training as D
from ragtables.operators import uploads as U

NOW = "2026-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


HOST = r"regexp_matches(regexp_replace(source_value, '^[\x00-\x20]+', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+')"


@query("valid_urls", f"SELECT source_id, coalesce({HOST}, false) AS is_valid FROM v_sources WHERE type = 'url'")
def valid_urls(spark, sf):
    urls = view(spark, sf, "v_sources").filter(B.is_url(F.col("type")))
    return urls.select("source_id", has_host(F.col("source_value")).alias("is_valid"))


@query("tenant_scope", "SELECT source_id, status FROM v_sources WHERE bot_id = 3 AND organization_id = 'org_0'")
def tenant_scope(spark, sf):
    return B.tenant_scope(view(spark, sf, "v_sources"), "org_0", 3).select("source_id", "status")


@query("trainable_sources", """
    SELECT source_id, bot_id, organization_id FROM v_sources WHERE status IN ('created') AND deleted_at IS NULL""")
def trainable_sources(spark, sf):
    return B.trainable_sources(view(spark, sf, "v_sources")).select("source_id", "bot_id", "organization_id")


@query("live_rows", "SELECT source_id, type, status FROM v_sources WHERE deleted_at IS NULL")
def live_rows(spark, sf):
    return B.live_rows(view(spark, sf, "v_sources")).select("source_id", "type", "status")


@query("pending_chunks", """
    SELECT source_id, chunk_index, document_id FROM v_chunks WHERE NOT is_active AND deleted_at IS NULL""")
def pending_chunks(spark, sf):
    return B.pending_chunks(view(spark, sf, "v_chunks")).select("source_id", "chunk_index", "document_id")


@query("chunks_in_order", """
    SELECT source_id, chunk_index, document_id, bot_id FROM v_chunks ORDER BY source_id, chunk_index, document_id""")
def chunks_in_order(spark, sf):
    return B.chunks_in_order(view(spark, sf, "v_chunks").select("source_id", "chunk_index", "document_id", "bot_id"))


@query("source_completeness", f"""
    SELECT source_id, coalesce(CASE
        WHEN type = 'url' AND (bot_id IS NULL OR organization_id IS NULL)
            THEN 'Training source missing bot_id/organization_id'
        WHEN type = 'url' AND NOT coalesce({HOST}, false) THEN 'Invalid URL: ' || coalesce(source_value, '')
        WHEN type <> 'url' AND coalesce(source_value, '') = ''
            THEN 'Missing file information for this training source.' END, '') AS error_message
    FROM v_sources""")
def source_completeness(spark, sf):
    checked = B.source_errors(view(spark, sf, "v_sources"))
    return checked.select("source_id", F.coalesce("error_message", F.lit("")).alias("error_message"))


@query("min_length_gate", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(text) < 200
                            THEN 'Page content too short after fallback extraction/cleaning'
                        WHEN doc_id % 2 = 1 AND length(text) < 50
                            THEN 'File content too short after loading the data from file' ELSE '' END AS error_message
    FROM documents""")
def min_length_gate(spark, sf):
    kind = F.when(F.col("doc_id") % 2 == 0, "url").otherwise("file")
    gate = B.min_length_gate(view(spark, sf, "documents").select(
        "doc_id", kind.alias("type"), F.length("text").alias("n_chars")))
    return gate.select("doc_id", F.coalesce("error_message", F.lit("")).alias("error_message"))


@query("bots_available_for_training", """
    SELECT c_custkey AS bot_id FROM customer c WHERE NOT EXISTS
        (SELECT 1 FROM v_jobs j WHERE j.bot_id = c.c_custkey AND j.status IN ('queued', 'processing'))""")
def bots_available_for_training(spark, sf):
    bots = view(spark, sf, "customer").select(F.col("c_custkey").alias("bot_id"))
    return D.bots_available_for_training(bots, view(spark, sf, "v_jobs"))


ENQUEUED = """
    links AS (SELECT sha256(s.organization_id || '|' || CAST(s.bot_id AS STRING) || '|run-1') AS job_id, s.*
              FROM v_sources s WHERE status = 'created' AND deleted_at IS NULL AND NOT EXISTS
                  (SELECT 1 FROM v_jobs j WHERE j.bot_id = s.bot_id AND j.status IN ('queued', 'processing')))"""


def _enqueue(spark, sf):
    return D.enqueue_jobs(view(spark, sf, "v_sources"), view(spark, sf, "v_jobs"), "run-1")


@query("enqueue_jobs", f"""
    WITH {ENQUEUED}
    SELECT job_id, bot_id, organization_id, count(*) AS n_sources, min(source_id) AS first_source_id,
           max(source_id) AS last_source_id, 'queued' AS status
    FROM links GROUP BY job_id, bot_id, organization_id""")
def enqueue_jobs(spark, sf):
    return _enqueue(spark, sf)[0]


@query("enqueue_job_sources", f"WITH {ENQUEUED} SELECT job_id, source_id FROM links")
def enqueue_job_sources(spark, sf):
    return _enqueue(spark, sf)[1]


@query("exists_first", """
    SELECT job_id FROM v_jobs WHERE status IN ('queued', 'processing') ORDER BY job_id LIMIT 1""")
def exists_first(spark, sf):
    """Is any job under way: the first one, if there is one."""
    busy = view(spark, sf, "v_jobs").filter(F.col("status").isin("queued", "processing"))
    return busy.select("job_id").orderBy("job_id").limit(1)


@query("queue_sources", f"""
    WITH {ENQUEUED}
    SELECT source_id, CASE WHEN source_id IN (SELECT source_id FROM links) THEN 'queued_for_training' ELSE status END
               AS status
    FROM v_sources""")
def queue_sources(spark, sf):
    return D.queue_sources(view(spark, sf, "v_sources"), _enqueue(spark, sf)[1]).select("source_id", "status")


@query("sources_for_job", """
    SELECT j.job_id, s.source_id, s.status FROM v_jobs j JOIN v_job_sources l ON j.job_id = l.job_id
    JOIN v_sources s ON s.source_id = l.source_id AND s.bot_id = j.bot_id AND s.organization_id = j.organization_id""")
def sources_for_job(spark, sf):
    jobs = view(spark, sf, "v_jobs").select("job_id", "bot_id", "organization_id")
    return (D.sources_for_job(jobs, view(spark, sf, "v_job_sources"), view(spark, sf, "v_sources"))
            .select("job_id", "source_id", "status"))


@query("source_file_lookup", """
    WITH by_path AS (SELECT path, count(*) AS n, min(file_id) AS file_id FROM v_files GROUP BY path)
    SELECT s.source_id, CASE WHEN n > 1 THEN 'Unable to locate the uploaded file for this training source.'
                             WHEN n IS NULL THEN 'Uploaded file metadata is incomplete.' ELSE '' END AS lookup_error,
           CASE WHEN n = 1 THEN file_id ELSE -1 END AS file_id
    FROM v_sources s LEFT JOIN by_path f ON f.path = s.source_value WHERE s.type = 'file'""")
def source_file_lookup(spark, sf):
    sources = view(spark, sf, "v_sources").filter(F.col("type") == "file")
    found = D.source_file_lookup(sources, view(spark, sf, "v_files"))
    return found.select("source_id", F.coalesce("lookup_error", F.lit("")).alias("lookup_error"),
                        F.coalesce("file_id", F.lit(-1)).alias("file_id"))


ROLLED_UP = """
    SELECT j.job_id, CASE WHEN coalesce(max(CAST(ok AS INT)), 0) = 0 THEN 'failed'
                          WHEN min(CAST(ok AS INT)) = 1 THEN 'completed' ELSE 'partially_completed' END AS status
    FROM v_jobs j LEFT JOIN v_source_outcomes o ON o.job_id = j.job_id GROUP BY j.job_id"""


@query("job_status_rollup", ROLLED_UP)
def job_status_rollup(spark, sf):
    jobs = view(spark, sf, "v_jobs").select("job_id")
    return D.job_status_rollup(jobs, view(spark, sf, "v_source_outcomes"))


@query("job_status_stream", ROLLED_UP)
def job_status_stream(spark, sf):
    """Outcomes of sources as a stream in three batches; the status of each job is kept up to date in a store."""
    from ragtables.session import scratch_path
    from ragtables.sources.snapshots import Store
    from ragtables.streaming.jobs import roll_up_stream

    base = scratch_path(spark, "outcomes")
    outcomes = view(spark, sf, "v_source_outcomes")
    for part in range(3):
        outcomes.filter(F.col("source_no") % 3 == part).write.mode("append").parquet(f"{base}/in")
    files = len(spark.read.schema(outcomes.schema).parquet(f"{base}/in").inputFiles())
    store = Store(spark, f"{base}/store")
    jobs = view(spark, sf, "v_jobs").select("job_id", F.lit("failed").alias("status"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    store.publish({"jobs": jobs})
    stream = spark.readStream.schema(outcomes.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(f"{base}/in")
    roll_up_stream(stream, store, f"{base}/checkpoint", _now()).awaitTermination()
    return store.read("jobs", D.JOB_CHANGES).select("job_id", "status")


@query("job_timestamps", f"""
    SELECT j.job_id, '{NOW}' AS started_at, '{NOW}' AS completed_at,
           CASE WHEN coalesce(max(CAST(ok AS INT)), 0) = 0 THEN 'failed'
                WHEN min(CAST(ok AS INT)) = 1 THEN 'completed' ELSE 'partially_completed' END AS status
    FROM v_jobs j LEFT JOIN v_source_outcomes o ON o.job_id = j.job_id GROUP BY j.job_id""")
def job_timestamps(spark, sf):
    started = D.start_jobs(view(spark, sf, "v_jobs").select("job_id"), _now())
    done = D.finish_jobs(started, view(spark, sf, "v_source_outcomes"), _now())
    return done.select("job_id", F.col("started_at").cast("string").alias("started_at"),
                       F.col("completed_at").cast("string").alias("completed_at"), "status")


@query("chunks_per_source", "SELECT source_id, count(*) AS n_chunks FROM v_chunks GROUP BY source_id")
def chunks_per_source(spark, sf):
    return D.chunks_per_source(view(spark, sf, "v_chunks"))


TOKENS = r"len(regexp_extract_all(content, '\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+'))"


@query("token_budget", f"""
    SELECT bot_id, source_id, count(*) AS n_chunks, CAST(sum({TOKENS}) AS BIGINT) AS total_tokens,
           max({TOKENS}) AS max_tokens
    FROM v_chunks GROUP BY bot_id, source_id""")
def token_budget(spark, sf):
    return D.token_budget(view(spark, sf, "v_chunks"), "bot_id", "source_id")


@query("chunks_without_embedding", """
    SELECT document_id, bot_id, chunk_index FROM v_chunks c WHERE NOT EXISTS
        (SELECT 1 FROM v_embeddings e WHERE e.document_id = c.document_id AND e.deleted_at IS NULL)""")
def chunks_without_embedding(spark, sf):
    chunks = view(spark, sf, "v_chunks").select("document_id", "bot_id", "chunk_index")
    return E.chunks_without_embedding(chunks, view(spark, sf, "v_embeddings"))


@query("distinct_embedded_ids", "SELECT DISTINCT document_id FROM v_embeddings WHERE deleted_at IS NULL")
def distinct_embedded_ids(spark, sf):
    return E.distinct_embedded_ids(view(spark, sf, "v_embeddings"))


@query("embeddings_of_source", """
    SELECT document_id FROM v_embeddings WHERE document_id IN
        (SELECT document_id FROM v_chunks WHERE source_id IN
            (SELECT source_id FROM v_chunks GROUP BY source_id HAVING min(document_id) % 2 = 0))""")
def embeddings_of_source(spark, sf):
    chunks = view(spark, sf, "v_chunks")
    doomed = chunks.groupBy("source_id").agg(F.min("document_id").alias("m")).filter("m % 2 = 0")
    return C.embeddings_of_source(view(spark, sf, "v_embeddings"), chunks, doomed).select("document_id")


@query("dedupe_chunk_inserts", """
    SELECT source_id, chunk_index, embedding_model, embedding_version, min(document_id) AS document_id
    FROM v_chunks c WHERE is_active AND NOT EXISTS
        (SELECT 1 FROM v_chunks s WHERE NOT s.is_active AND s.source_id = c.source_id
             AND s.chunk_index = c.chunk_index AND s.embedding_model = c.embedding_model
             AND s.embedding_version = c.embedding_version)
    GROUP BY source_id, chunk_index, embedding_model, embedding_version""")
def dedupe_chunk_inserts(spark, sf):
    """Active chunks stand for a batch that comes in, the others for what is stored."""
    chunks = view(spark, sf, "v_chunks")
    fresh = D.dedupe_chunk_inserts(chunks.filter("is_active"), chunks.filter("NOT is_active"))
    return fresh.select(*D.CHUNK_KEY, "document_id")


@query("apply_source_outcome", """
    SELECT source_id, CASE WHEN n IS NULL THEN status WHEN bad = 0 THEN 'trained' ELSE 'training_failed' END AS status,
           CASE WHEN bad > 0 THEN 'Failed to fetch URL' ELSE '' END AS error_message
    FROM v_sources s LEFT JOIN (SELECT job_id, count(*) AS n, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS bad
                                FROM v_source_outcomes GROUP BY job_id) r ON r.job_id = s.source_id""")
def apply_source_outcome(spark, sf):
    """Results stand in as one per order: failed if any of its lines was returned."""
    error = F.when(F.bool_or(~F.col("ok")), "Failed to fetch URL")
    results = (view(spark, sf, "v_source_outcomes").groupBy(F.col("job_id").alias("source_id"))
               .agg(error.alias("error_message")))
    sources = view(spark, sf, "v_sources").withColumn("error_message", F.lit(None).cast("string"))
    done = D.apply_source_outcome(sources, results)
    return done.select("source_id", "status", F.coalesce("error_message", F.lit("")).alias("error_message"))


@query("activate_chunks", """
    SELECT document_id, is_active OR document_id IN (SELECT document_id FROM v_embeddings) AS is_active
    FROM v_chunks""")
def activate_chunks(spark, sf):
    chunks = view(spark, sf, "v_chunks").select("document_id", "is_active")
    return D.activate_chunks(chunks, view(spark, sf, "v_embeddings"))


@query("column_defaults", """
    SELECT conv_id, turn, coalesce(role, 'user') AS role, CAST(coalesce(CAST(timestamp AS STRING),
           '2026-02-01 00:00:00') AS STRING) AS created_at, coalesce(content_type = 'file', true) AS is_active
    FROM v_raw_messages""")
def column_defaults(spark, sf):
    """Missing values become the defaults that the schema of the chunk table and the message contract declare."""
    from ragtables.schemas import with_defaults

    raw = view(spark, sf, "v_raw_messages")
    rows = raw.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"),
                      F.col("timestamp").alias("created_at"), (F.col("content_type") == "file").alias("is_active"))
    done = with_defaults(rows, "documents", NOW)
    return done.withColumn("created_at", F.col("created_at").cast("string"))


CLEANUP = """
    targets AS (SELECT j.job_id, j.job_id + 7 AS source_id, s.type, s.source_value,
                       CASE WHEN s.source_id IS NULL THEN 'source_gone'
                            WHEN s.deleted_at IS NULL THEN 'not_deleted' ELSE 'run' END AS action
                FROM v_jobs j LEFT JOIN v_sources s ON s.source_id = j.job_id + 7)"""


def _targets(spark, sf):
    jobs = view(spark, sf, "v_jobs").select("job_id", (F.col("job_id") + 7).alias("source_id"))
    return C.cleanup_target(jobs, view(spark, sf, "v_sources"))


@query("cleanup_target", f"WITH {CLEANUP} SELECT job_id, source_id, action FROM targets")
def cleanup_target(spark, sf):
    return _targets(spark, sf)


@query("apply_cleanup_outcome", f"""
    WITH {CLEANUP}
    SELECT job_id, CASE WHEN action = 'not_deleted' THEN 'failed' ELSE 'cleanup_completed' END AS status,
           '{NOW}' AS completed_at FROM targets""")
def apply_cleanup_outcome(spark, sf):
    done = C.apply_cleanup_outcome(_targets(spark, sf), _now())
    return done.select("job_id", "status", F.col("completed_at").cast("string").alias("completed_at"))


@query("deletion_manifest", f"""
    WITH {CLEANUP}
    SELECT source_id, 'bot-files' AS bucket, source_value AS path FROM targets
    WHERE action = 'run' AND type = 'file' AND coalesce(source_value, '') <> ''
      AND source_value IN (SELECT path FROM v_objects)""")
def deletion_manifest(spark, sf):
    run = _targets(spark, sf).filter("action = 'run'").select("source_id")
    sources = view(spark, sf, "v_sources").join(run, "source_id")
    return C.deletion_manifest(sources, view(spark, sf, "v_objects"))


DOOMED = "(SELECT source_id FROM v_chunks GROUP BY source_id HAVING min(document_id) % 2 = 0)"


def _soft_deleted(spark, sf):
    chunks = view(spark, sf, "v_chunks")
    doomed = chunks.groupBy("source_id").agg(F.min("document_id").alias("m")).filter("m % 2 = 0")
    return C.soft_delete_source(chunks, view(spark, sf, "v_embeddings"), doomed, _now())


@query("soft_delete_source", f"""
    SELECT document_id, is_active, coalesce(CAST(deleted_at AS STRING),
           CASE WHEN source_id IN {DOOMED} THEN '{NOW}' ELSE '' END) AS deleted_at FROM v_chunks""")
def soft_delete_source(spark, sf):
    chunks = _soft_deleted(spark, sf)[1]
    return chunks.select("document_id", "is_active",
                         F.coalesce(F.col("deleted_at").cast("string"), F.lit("")).alias("deleted_at"))


@query("soft_delete_embeddings", f"""
    SELECT document_id, coalesce(CAST(deleted_at AS STRING),
           CASE WHEN document_id IN (SELECT document_id FROM v_chunks WHERE source_id IN {DOOMED}) THEN '{NOW}'
                ELSE '' END) AS deleted_at FROM v_embeddings""")
def soft_delete_embeddings(spark, sf):
    vectors = _soft_deleted(spark, sf)[0]
    return vectors.select("document_id",
                          F.coalesce(F.col("deleted_at").cast("string"), F.lit("")).alias("deleted_at"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return view(spark, sf, "documents").select("doc_id", U.content_hash(F.col("text")).alias("content_hash"))


@query("match_by_content_hash", """
    WITH known AS (SELECT bot_id, sha256(text) AS h, CAST(min(doc_id) AS STRING) AS existing_id
                   FROM v_hashed_documents WHERE is_known GROUP BY bot_id, sha256(text))
    SELECT u.doc_id, coalesce(existing_id, sha256(CAST(u.bot_id AS STRING) || '|' || sha256(u.text))) AS source_id,
           existing_id IS NULL AS is_new
    FROM v_hashed_documents u LEFT JOIN known k ON k.bot_id = u.bot_id AND k.h = sha256(u.text)
    WHERE NOT u.is_known""")
def match_by_content_hash(spark, sf):
    """Labelled documents are known sources; the others are uploads."""
    hashed = view(spark, sf, "v_hashed_documents").select(
        "doc_id", "bot_id", "is_known", U.content_hash(F.col("text")).alias("content_hash"))
    known = hashed.filter("is_known").withColumnRenamed("doc_id", "source_id")
    return U.match_by_content_hash(hashed.filter("NOT is_known"), known).select("doc_id", "source_id", "is_new")


@query("verify_uploads", """
    SELECT source_id, CASE WHEN status <> 'pending' OR type <> 'file' THEN status
                           WHEN source_value IN (SELECT path FROM v_objects) THEN 'created'
                           ELSE 'upload_failed' END AS status,
           CASE WHEN status = 'pending' AND type = 'file' AND source_value IN (SELECT path FROM v_objects)
                THEN 'uploaded' ELSE '' END AS file_status
    FROM v_sources""")
def verify_uploads(spark, sf):
    done = U.verify_uploads(view(spark, sf, "v_sources"), view(spark, sf, "v_objects"), "bot-files")
    return done.select("source_id", "status", F.coalesce("file_status", F.lit("")).alias("file_status"))


@query("orphan_uploads", """
    SELECT 'source_without_object' AS kind, CAST(source_id AS STRING) AS ref FROM v_sources
    WHERE type = 'file' AND status = 'pending' AND source_value IS NOT NULL
      AND source_value NOT IN (SELECT path FROM v_objects)
    UNION ALL
    SELECT 'object_without_source' AS kind, path AS ref FROM v_objects
    WHERE path NOT IN (SELECT source_value FROM v_sources WHERE type = 'file' AND source_value IS NOT NULL)""")
def orphan_uploads(spark, sf):
    return U.orphan_uploads(view(spark, sf, "v_sources"), view(spark, sf, "v_objects"), "bot-files")

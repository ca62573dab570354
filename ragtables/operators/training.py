"""Training jobs: who may train, which sources belong to a job, outcomes and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtables.fixed_values import (
    CHUNK_OVERLAP, CHUNK_SIZE, EMBEDDING_MODEL, EMBEDDING_PROVIDER, EMBEDDING_VERSION, ERR_FILE_AMBIGUOUS,
    ERR_FILE_METADATA,
)
from ragtables.functions.names import normal_path
from ragtables.functions.text import count_tokens
from ragtables.operators.bounded import broadcast_if_small
from ragtables.operators.filters import trainable_sources
from ragtables.sources.snapshots import Change, Store

#: What marks of sources and of jobs change.
SOURCE_CHANGES = (Change("status", "last"),)
JOB_CHANGES = (Change("status", "last"), Change("completed_at", "last"))
CHUNK_KEY = ("source_id", "chunk_index", "embedding_model", "embedding_version")


def natural_id(*parts: Column) -> Column:
    """Stable row id from a natural key; unlike a random id it survives the re-run of a lost task."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def bots_available_for_training(bots: DataFrame, jobs: DataFrame) -> DataFrame:
    """Bots without a queued or processing job."""
    busy = jobs.filter(F.col("status").isin("queued", "processing")).select("bot_id").distinct()
    return bots.join(busy, "bot_id", "left_anti")


def enqueue_jobs(sources: DataFrame, jobs: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """One queued job per available bot that has trainable sources, and the sources of each job.

    The source list is a table with one row per source rather than an array in the job row, so that a bot with very
    many sources stays spread out. Returns (jobs, job_sources).
    """
    job_id = natural_id(F.col("organization_id"), F.col("bot_id"), F.lit(run_id))
    links = (bots_available_for_training(trainable_sources(sources), jobs)
             .select(job_id.alias("job_id"), "bot_id", "organization_id", "source_id"))
    queued = (links.groupBy("job_id", "bot_id", "organization_id")
              .agg(F.count("*").alias("n_sources"), F.min("source_id").alias("first_source_id"),
                   F.max("source_id").alias("last_source_id"))
              .withColumn("status", F.lit("queued")))
    return queued, links.select("job_id", "source_id")


def queue_sources(sources: DataFrame, job_sources: DataFrame) -> DataFrame:
    """Sources with the status 'queued_for_training' where a job took them."""
    taken = job_sources.select("source_id").distinct().withColumn("_taken", F.lit(True))
    status = F.when(F.col("_taken"), "queued_for_training").otherwise(F.col("status"))
    return sources.join(taken, "source_id", "left").withColumn("status", status).drop("_taken")


def sources_for_job(jobs: DataFrame, job_sources: DataFrame, sources: DataFrame) -> DataFrame:
    """Listed sources that belong to the job's own bot and organization."""
    listed = jobs.select("job_id", "bot_id", "organization_id").join(job_sources, "job_id")
    return listed.join(sources, ["source_id", "bot_id", "organization_id"])


def source_file_lookup(sources: DataFrame, files: DataFrame) -> DataFrame:
    """File record of each file source by its normal path. Not exactly one record is an error; tenant and deletion do not count.

    The files are brought to one row per path before the join, which therefore cannot multiply sources.
    """
    by_path = files.groupBy("path").agg(
        F.count("*").alias("n_records"),
        F.min(F.struct("file_id", "bucket", "original_filename", "mime_type")).alias("f"))
    found = sources.withColumn("path", normal_path(F.col("source_value"))).join(by_path, "path", "left")
    message = (F.when(F.col("n_records") > 1, ERR_FILE_AMBIGUOUS)
               .when(F.col("n_records").isNull() | F.col("f.bucket").isNull(), ERR_FILE_METADATA))
    only = F.when(F.col("n_records") == 1, F.col("f"))
    return (found.withColumn("lookup_error", message).withColumn("f", only)
            .select(*sources.columns, "path", "lookup_error", "f.*"))


def chunk_provenance(chunks: DataFrame, chunk_size: int = CHUNK_SIZE, chunk_overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Columns that tell how a chunk was made; new chunks are inactive until they have a vector."""
    out = chunks.withColumns({
        "chunk_size": F.lit(chunk_size), "chunk_overlap": F.lit(chunk_overlap),
        "token_count": count_tokens(F.col("content")),
        "embedding_model": F.lit(EMBEDDING_MODEL), "embedding_version": F.lit(EMBEDDING_VERSION),
        "embedding_provider": F.lit(EMBEDDING_PROVIDER), "is_active": F.lit(False),
        "deleted_at": F.lit(None).cast("timestamp"),
    })
    return out.withColumn("document_id", natural_id(*[F.col(c) for c in CHUNK_KEY]))


def fresh_chunk_keys(hashed: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, document_id, _hash, n): for each incoming key that is not stored the least id and hash of its n rows. No content is read."""
    key = list(CHUNK_KEY)
    fresh = hashed.select(*key, "document_id", "_hash").join(stored.select(*key), key, "left_anti")
    return fresh.groupBy(*key).agg(F.min(F.struct("document_id", "_hash")).alias("r"), F.count("*").alias("n")).select(*key, "r.*", "n")


def dedupe_chunk_inserts(incoming: DataFrame, stored: DataFrame, written: bool = False) -> DataFrame:
    """Incoming chunks whose key is not stored yet, once per key. Deleted rows still block their key.

    Of several incoming rows with one key the smallest document id stays, of equal ones the smallest hash of the content.
    What is kept is settled on keys, ids and hashes; contents meet the kept keys once, at the end, by a broadcast of these
    while their measured bytes allow. Rows that are ``written`` already are given back as they are if all of them stay.
    """
    key = [*CHUNK_KEY, "document_id", "_hash"]
    hashed = incoming.withColumn("_hash", F.xxhash64("content"))
    fresh = broadcast_if_small(fresh_chunk_keys(hashed, stored))
    # A key that holds NULL meets nothing in the join below.
    found = fresh.filter(F.concat(*key).isNotNull()).agg(F.count("*").alias("keys"), F.max("n").alias("most")).first()
    if written and (found["most"] or 1) == 1 and found["keys"] == incoming.count():
        return incoming
    kept = hashed.join(fresh, key)
    if (found["most"] or 1) == 1:
        return kept.select(incoming.columns)
    once = kept.filter("n = 1").select(incoming.columns)
    return once.unionByName(kept.filter("n > 1").dropDuplicates(key).select(incoming.columns))


def job_status() -> Column:
    """Status of a job from whether any of its sources succeeded (``any_ok``) and any failed (``any_bad``)."""
    ok, bad = F.coalesce("any_ok", F.lit(False)), F.coalesce("any_bad", F.lit(False))
    return F.when(ok & ~bad, "completed").when(ok & bad, "partially_completed").otherwise("failed")


def job_status_rollup(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Final status of each job from its sources' results; a job without any source has failed."""
    per_job = outcomes.groupBy("job_id").agg(F.bool_or("ok").alias("any_ok"), F.bool_or(~F.col("ok")).alias("any_bad"))
    return jobs.join(per_job, "job_id", "left").withColumn("status", job_status()).drop("any_ok", "any_bad")


def start_jobs(jobs: DataFrame, now) -> DataFrame:
    """Jobs at their start."""
    return jobs.withColumns({"status": F.lit("processing"), "started_at": now})


def finish_jobs(jobs: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """Jobs at their end, whatever the result."""
    return job_status_rollup(jobs, outcomes).withColumn("completed_at", now)


def apply_source_outcome(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Sources after training: 'trained', or 'training_failed' with the message. ``results`` has one row per source
    that was worked on; others, and the message of a source that succeeded, stay as they are."""
    done = results.select("source_id", F.col("error_message").alias("_error"), F.lit(True).alias("_done"))
    status = (F.when(F.col("_done") & F.col("_error").isNull(), "trained")
              .when(F.col("_done"), "training_failed").otherwise(F.col("status")))
    return (sources.join(done, "source_id", "left").withColumn("status", status)
            .withColumn("error_message", F.coalesce("_error", "error_message")).drop("_error", "_done"))


def activate_chunks(chunks: DataFrame, new_vectors: DataFrame) -> DataFrame:
    """Chunks marked active where a vector now exists."""
    ids = broadcast_if_small(new_vectors.select("document_id").distinct()).withColumn("_hit", F.lit(True))
    return (chunks.join(ids, "document_id", "left")
            .withColumn("is_active", F.coalesce("_hit", "is_active")).drop("_hit"))


def mark_active(store: Store, vectors: DataFrame) -> int:
    """Activation in a store: a mark per document that has a vector in ``vectors``."""
    ids = vectors.select("document_id").distinct().withColumn("is_active", F.lit(True))
    return store.publish(marks={"chunks": ("document_id", ids)})


def mark_queued(store: Store, job_sources: DataFrame) -> int:
    """Sources of jobs in a store as 'queued_for_training', by a mark per source. Readers use ``SOURCE_CHANGES``."""
    ids = job_sources.select("source_id").distinct().withColumn("status", F.lit("queued_for_training"))
    return store.publish(marks={"sources": ("source_id", ids)})


def chunks_per_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count("*").alias("n_chunks"))


def token_budget(chunks: DataFrame, *keys: str) -> DataFrame:
    """Tokens per group: total and largest chunk."""
    tokens = count_tokens(F.col("content"))
    return (chunks.withColumn("tokens", tokens).groupBy(*keys)
            .agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("total_tokens"),
                 F.max("tokens").alias("max_tokens")))

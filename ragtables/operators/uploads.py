"""Uploads: recognition of known content, verification, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.operators.training import natural_id


def content_hash(content):
    """Fingerprint of a text or binary column."""
    return F.sha2(content, 256)


def match_by_content_hash(uploads: DataFrame, sources: DataFrame) -> DataFrame:
    """Source of each upload: an existing one of the bot with the same content, else a new pending one.

    Copies within a batch get the same new id. Known sources are brought to one row per (bot, hash) first.
    """
    known = (sources.filter(F.col("content_hash").isNotNull()).groupBy("bot_id", "content_hash")
             .agg(F.min("source_id").cast("string").alias("existing_id")))
    new_id = natural_id(F.col("bot_id"), F.col("content_hash"))
    return (uploads.join(known, ["bot_id", "content_hash"], "left")
            .withColumn("source_id", F.coalesce("existing_id", new_id))
            .withColumn("is_new", F.col("existing_id").isNull())
            .withColumn("status", F.when(F.col("is_new"), "pending")).drop("existing_id"))


def verify_uploads(sources: DataFrame, objects: DataFrame, bucket: str) -> DataFrame:
    """Pending file sources: 'created', with a file row 'uploaded', if the object is in storage, else
    'upload_failed'. Sources in other states stay as they are."""
    stored = (objects.filter(F.col("bucket") == bucket).select(F.col("path").alias("source_value"))
              .distinct().withColumn("_stored", F.lit(True)))
    pending = (F.col("status") == "pending") & (F.col("type") == "file")
    status = (F.when(pending & F.col("_stored"), "created").when(pending, "upload_failed")
              .otherwise(F.col("status")))
    file_status = F.when(pending & F.col("_stored"), "uploaded")
    return (sources.join(stored, "source_value", "left").withColumn("file_status", file_status)
            .withColumn("status", status).drop("_stored"))


def orphan_uploads(sources: DataFrame, objects: DataFrame, bucket: str) -> DataFrame:
    """(kind, ref): pending file sources whose object never came, and objects that no source names."""
    wanted = sources.filter((F.col("type") == "file") & F.col("source_value").isNotNull())
    paths = objects.filter(F.col("bucket") == bucket).select("path")
    abandoned = (wanted.filter(F.col("status") == "pending")
                 .join(paths, F.col("source_value") == F.col("path"), "left_anti")
                 .select(F.lit("source_without_object").alias("kind"), F.col("source_id").cast("string").alias("ref")))
    unnamed = (paths.join(wanted.select("source_value"), F.col("path") == F.col("source_value"), "left_anti")
               .select(F.lit("object_without_source").alias("kind"), F.col("path").alias("ref")))
    return abandoned.unionByName(unnamed)

"""Row-level rules: visibility, tenancy, admission of sources and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtables.fixed_values import (
    ERR_FILE_SHORT, ERR_INVALID_URL, ERR_NO_FILE_INFO, ERR_NO_TENANT, ERR_PAGE_SHORT, MESSAGE_CONTENT_TYPES,
    MESSAGE_ROLES, MIN_FILE_CHARS, MIN_URL_CHARS, SYSTEM_PROMPT,
)
from ragtables.functions.names import has_host


def live_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def tenant_scope(df: DataFrame, organization_id, bot_id) -> DataFrame:
    return df.filter((F.col("organization_id") == F.lit(organization_id)) & (F.col("bot_id") == F.lit(bot_id)))


def trainable_sources(sources: DataFrame) -> DataFrame:
    """Live sources that wait for training."""
    return live_rows(sources.filter(F.col("status").isin("created")))


def pending_chunks(chunks: DataFrame) -> DataFrame:
    """Live chunks that have no vector yet, in order within each task's share."""
    return live_rows(chunks.filter(~F.col("is_active"))).sortWithinPartitions("source_id", "chunk_index")


def chunks_in_order(chunks: DataFrame) -> DataFrame:
    """Total order by source and chunk number; Spark range-partitions on both, so one large source spreads out."""
    return chunks.orderBy("source_id", "chunk_index", "document_id")


def is_url(kind: Column) -> Column:
    """Anything that is not a URL source, a missing type included, is a file source."""
    return kind.eqNullSafe(F.lit("url"))


def source_errors(sources: DataFrame) -> DataFrame:
    """Add ``error_message``: the first rule that a source breaks before any of its content is read, else NULL."""
    url, value = is_url(F.col("type")), F.col("source_value")
    no_tenant = F.col("bot_id").isNull() | F.col("organization_id").isNull()
    message = (F.when(url & no_tenant, ERR_NO_TENANT)
               .when(url & ~F.coalesce(has_host(value), F.lit(False)),
                     F.concat(F.lit(f"{ERR_INVALID_URL}: "), F.coalesce(value, F.lit(""))))
               .when(~url & (F.coalesce(value, F.lit("")) == ""), ERR_NO_FILE_INFO))
    return sources.withColumn("error_message", message)


def min_length_gate(texts: DataFrame, n_chars: str = "n_chars") -> DataFrame:
    """Add ``error_message`` where the cleaned text is too short for its type of source."""
    url = is_url(F.col("type"))
    short = F.coalesce(F.col(n_chars), F.lit(0)) < F.when(url, MIN_URL_CHARS).otherwise(MIN_FILE_CHARS)
    return texts.withColumn(
        "error_message", F.when(short, F.when(url, ERR_PAGE_SHORT).otherwise(ERR_FILE_SHORT)))


def message_contract(messages: DataFrame, now) -> DataFrame:
    """Fill in the defaults of chat messages, rename the time column and add ``reason`` for those to quarantine."""
    def is_empty(name):
        return F.coalesce(F.length(name), F.lit(0)) < 1

    filled = messages.select(
        *[c for c in messages.columns if c not in ("role", "content_type", "timestamp")],
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("content_type", F.lit("text")).alias("content_type"),
        F.coalesce("timestamp", F.lit(now).cast(messages.schema["timestamp"].dataType)).alias("created_at"))
    return filled.withColumn(
        "reason", F.when(is_empty("content"), "content")
        .when(~F.col("role").isin(*MESSAGE_ROLES), "role")
        .when(~F.col("content_type").isin(*MESSAGE_CONTENT_TYPES), "content_type")
        .when(is_empty("conversation_id"), "conversation_id"))


def prompt_projection(messages: DataFrame) -> DataFrame:
    """Add ``prompt``: the system message, then the user's text, which is the message, else the content, else ''."""
    text = F.coalesce(F.nullif(F.col("message"), F.lit("")), F.nullif(F.col("content"), F.lit("")), F.lit(""))

    def entry(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return messages.withColumn("prompt", F.array(entry("system", F.lit(SYSTEM_PROMPT)), entry("user", text)))

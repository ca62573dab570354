"""Writing of chunks, vectors and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks in folders per bot. The rebalance hint lets Spark split a large bot over files and pool small
    ones; the commit at the end of the job makes a batch visible as a whole or not at all."""
    chunks.hint("rebalance", "bot_id").write.mode("append").partitionBy("bot_id").parquet(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """Append (document_id, embedding) rows."""
    vectors.write.mode("append").parquet(path)


def save_bucketed(df: DataFrame, table: str, buckets: int, path: str | None = None, key: str = "document_id") -> None:
    """Table bucketed and sorted by key: joins of such tables on the key need no shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write a new version of a rewritten table beside the old one; fails if that version exists."""
    path = f"{base.rstrip('/')}/v{version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path

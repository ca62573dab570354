"""Ingestion: from training sources to chunks and vectors.

sources -> checks -> (pages: extract, clean | files: look up, read, clean) -> length gate -> chunks -> vectors.
A source that fails carries its message along and never stops the others. Texts are kept apart from the rows about
sources, so that checks and results never move text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.fixed_values import (
    CHUNK_OVERLAP, CHUNK_SIZE, EMBEDDING_DIMENSIONS, ERR_FILE_MISSING, ERR_PAGE_FETCH, ERR_PAGE_SHORT,
)
from ragtables.functions.text import clean_text
from ragtables.operators.bounded import broadcast_if_small
from ragtables.operators.chunking import chunk_documents
from ragtables.operators.cleanup import VECTOR_CHANGES
from ragtables.operators.embedding import Embedder, embed_chunks
from ragtables.operators.filters import is_url, min_length_gate, source_errors
from ragtables.operators.html_text import extract_text, page_text_with_fallback
from ragtables.operators.long_files import MAX_WHOLE_CHARS, chunk_parts
from ragtables.operators.training import chunk_provenance, dedupe_chunk_inserts, source_file_lookup
from ragtables.session import drop_folder, materialize, passing_scratch, spread
from ragtables.sources.files import route_files
from ragtables.sources.pages import judge_pages
from ragtables.sources.snapshots import Store

OWNER = ("source_id", "bot_id", "organization_id")
SOURCE_COLUMNS = ("source_id", "bot_id", "organization_id", "type", "n_chars", "error_message")


class Texts(NamedTuple):
    """Rows about sources with length and error, cleaned page texts by owner, cleaned file parts by owner.

    The owner is source, bot and organization; it goes with the text, so that chunks need no join to learn it.
    """

    sources: DataFrame
    pages: DataFrame
    parts: DataFrame


class Ingested(NamedTuple):
    """New chunk rows, active and not deleted, to be stored after their vectors; these vectors; and (source_id, error_message) of every source."""

    chunks: DataFrame
    vectors: DataFrame
    results: DataFrame


def url_sources(sources: DataFrame, page_texts: DataFrame) -> DataFrame:
    """URL sources with ``n_chars``, ``error_message`` and the page that serves them."""
    page = page_texts.select(F.col("url").alias("source_value"), F.length("text").alias("n_chars"), "reason", "method",
                             "page_id", "parse_error")
    found = sources.join(page, "source_value", "left")
    error = (F.when(F.col("error_message").isNotNull(), F.col("error_message"))
             .when(F.col("method").isNull(), F.coalesce("reason", F.lit(ERR_PAGE_FETCH)))
             .when(F.col("method") == "none", F.coalesce("parse_error", F.lit(ERR_PAGE_SHORT))))
    return found.withColumn("error_message", error)


def landed_page_texts(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, page_id, reason, text, method) of the landed pages that sources ask for, one per URL.

    Which page serves a URL is settled on narrow rows; admitted pages come first. Only wanted pages are parsed: their ids
    are broadcast to the scan while the measured table allows, else Spark shuffles both sides.
    """
    wanted = sources.select(F.col("source_value").alias("url")).distinct()
    judged = judge_pages(pages)
    first = F.min(F.struct(F.col("reason").isNotNull().alias("rejected"), "page_id", "reason")).alias("p")
    chosen = materialize(judged.join(wanted, "url", "left_semi").groupBy("url").agg(first)
                         .select("url", "p.page_id", "p.reason"), "chosen")
    admitted = spread(judged.filter(F.col("reason").isNull()).select("page_id", "html"), "page_id")
    ids = broadcast_if_small(chosen.filter(F.col("reason").isNull()).select("page_id"))
    admitted = admitted.join(ids, "page_id", "left_semi")
    texts = page_text_with_fallback(extract_text(admitted)).select("page_id", "text", "method", "parse_error")
    return chosen.join(texts, "page_id", "left")


def file_sources(sources: DataFrame, files: DataFrame, objects: DataFrame, lengths: DataFrame) -> DataFrame:
    """File sources with ``n_chars``, ``error_message`` and ``file_id``; ``lengths`` is (file_id, n_chars)."""
    found = route_files(source_file_lookup(sources, files))
    stored = objects.select("bucket", "path").distinct().withColumn("stored", F.lit(True))
    sized = found.join(stored, ["bucket", "path"], "left").join(lengths, "file_id", "left")
    gate = min_length_gate(sized.withColumn("_earlier", F.col("error_message")))
    error = F.coalesce("_earlier", "lookup_error", F.when(F.col("stored").isNull(), F.lit(ERR_FILE_MISSING)),
                       "reason", "error_message")
    return gate.withColumn("error_message", error)


def ingest_union(sources: DataFrame, pages: DataFrame, files: DataFrame, objects: DataFrame,
                 parts: DataFrame) -> Texts:
    """Both kinds of sources to texts. ``parts(file_id, part_no, text)`` holds the files as read, part by part.

    Cleaned texts, and the rows about sources, are written to the shared folder, as several steps need them.
    """
    checked = source_errors(sources)
    urls, others = checked.filter(is_url(F.col("type"))), checked.filter(~is_url(F.col("type")))
    page_texts = materialize(landed_page_texts(urls, pages), "pages")
    # Only the parts of files that some source asks for are cleaned.
    asked = broadcast_if_small(source_file_lookup(others, files).select("file_id").filter("file_id is not null").distinct())
    parts = parts.join(asked, "file_id", "left_semi")
    # Filtered after the write: a filter on the cleaned text would be pushed below it and clean every part twice.
    file_parts = materialize(parts.withColumn("text", clean_text(F.col("text"))), "parts").filter(F.col("text") != "")
    # A blank line lies between parts, so a file is two characters longer per part after the first.
    lengths = file_parts.groupBy("file_id").agg((F.sum(F.length("text") + 2) - 2).cast("int").alias("n_chars"))
    url_rows, file_rows = url_sources(urls, page_texts), file_sources(others, files, objects, lengths)
    rows = materialize(url_rows.select(*SOURCE_COLUMNS, "page_id").unionByName(
        file_rows.select(*SOURCE_COLUMNS, "file_id"), allowMissingColumns=True), "sources")
    good = rows.filter(F.col("error_message").isNull())
    good_pages = good.filter(F.col("page_id").isNotNull()).select(*OWNER, "page_id")
    good_files = good.filter(F.col("file_id").isNotNull()).select(F.struct(*OWNER).alias("owner"), "file_id")
    return Texts(
        rows.select(*SOURCE_COLUMNS),
        page_texts.select("page_id", "text").join(good_pages, "page_id").select(*OWNER, "text"),
        file_parts.join(good_files, "file_id").select(F.col("owner").alias("file_id"), "part_no", "text"))


def ingest(sources: DataFrame, pages: DataFrame, files: DataFrame, objects: DataFrame, parts: DataFrame,
           stored_chunks: DataFrame, stored_vectors: DataFrame, chunk_size: int = CHUNK_SIZE,
           chunk_overlap: int = CHUNK_OVERLAP, dimensions: int = EMBEDDING_DIMENSIONS,
           embedder: Embedder | None = None, max_whole_chars: int = MAX_WHOLE_CHARS,
           write: Callable[[DataFrame, str], DataFrame] = materialize) -> Ingested:
    """One batch; chunks and vectors that are stored already are not made again.

    ``write`` puts the chunks where they stay and reads them back. They are written as they are made and once more only if
    some of them are stored already or come twice, so that texts are moved and cut once.
    """
    texts = ingest_union(sources, pages, files, objects, parts)
    of_pages = chunk_documents(texts.pages, "text", chunk_size, chunk_overlap).drop("start")
    of_files = chunk_parts(materialize(texts.parts, "owned"), chunk_size, chunk_overlap, max_whole_chars).select(
        "file_id.*", F.col("chunk_index").cast("int").alias("chunk_index"), "content")
    chunks = chunk_provenance(of_pages.unionByName(of_files), chunk_size, chunk_overlap)
    # Each of these chunks has its vector here or in the stored table: they are active once both tables are stored.
    made = write(chunks.withColumn("is_active", F.lit(True)), "chunks")
    kept = dedupe_chunk_inserts(made, stored_chunks, written=True)
    fresh = made if kept is made else write(kept, "chunks")
    have = broadcast_if_small(stored_vectors.filter(F.col("deleted_at").isNull()).select("document_id", "deleted_at"))
    vectors = embed_chunks(fresh, have, dimensions, embedder).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return Ingested(fresh, vectors, texts.sources.select("source_id", "error_message"))


#: Columns of the stored keys that a batch is held against.
_KEYS = "source_id string, chunk_index int, embedding_model string, embedding_version string"


def ingest_into(store: Store, sources: DataFrame, pages: DataFrame, files: DataFrame, objects: DataFrame, parts: DataFrame,
                writer: str, batch: int, **options) -> int:
    """One batch into a store: its chunks, their vectors, the outcome of every source and the sources that failed become
    seen together, in one version. A batch that the store has from this writer adds nothing; gives the store's version.

    Tables: chunks, vectors, outcomes (source_id, status, error_message, batch), and dead_letters, the rows of failed
    sources with their message, to be sent again. ``options`` are those of :func:`ingest`.
    """
    spark = store.spark
    if store.has_batch(writer, batch):
        return store.version()
    stored_chunks = store.read("chunks") if store.has("chunks") else spark.createDataFrame([], _KEYS)
    stored_vectors = (store.read("vectors", VECTOR_CHANGES) if store.has("vectors")
                      else spark.createDataFrame([], "document_id string, deleted_at timestamp"))
    sources = sources.dropDuplicates(["source_id"])
    folders: list[str] = []

    def staged(df: DataFrame, name: str) -> DataFrame:
        folders.append(store.stage(name, df))
        return spark.read.schema(df.schema).parquet(f"{store.base}/{folders[-1]}")

    with passing_scratch(spark, "batch"):
        done = ingest(sources, pages, files, objects, parts, stored_chunks, stored_vectors, write=staged, **options)
        failed = F.col("error_message").isNotNull()
        outcomes = done.results.select("source_id", F.when(failed, "training_failed").otherwise("trained").alias("status"),
                                       "error_message", F.lit(batch).cast("long").alias("batch"))
        letters = sources.join(done.results.filter(failed).select("source_id", "error_message"), "source_id")
        tables = {"vectors": done.vectors, "outcomes": outcomes, "dead_letters": letters.withColumn("batch", F.lit(batch).cast("long"))}
        rows = [(name, "rows", store.stage(name, df), df.schema) for name, df in tables.items()]
    for folder in folders[:-1]:
        drop_folder(spark, f"{store.base}/{folder}")
    return store.commit_staged([*rows, ("chunks", "rows", folders[-1], done.chunks.schema)], writer, batch)


def newest_outcomes(store: Store) -> DataFrame:
    """(source_id, status, error_message) of every source that a batch has worked on, from its newest batch."""
    rows = store.rows("outcomes")
    return rows.groupBy("source_id").agg(F.max_by(F.struct("status", "error_message"), "_added").alias("o")).select("source_id", "o.*")

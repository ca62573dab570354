"""Incremental ingestion: consume landed sources as a stream, add what is new to the chunk and vector tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ragtables.fixed_values import EMBEDDING_DIMENSIONS
from ragtables.operators.chunking import chunk_documents
from ragtables.operators.embedding import Embedder, chunks_without_embedding, embed
from ragtables.operators.training import chunk_provenance, dedupe_chunk_inserts
from ragtables.plans.ingest import ingest_into
from ragtables.session import materialize
from ragtables.sources.snapshots import Store

FOLDERS = 256


def folder_of(source_id: Column, folders: int = FOLDERS) -> Column:
    """Folder of a source in the chunk and vector tables."""
    return F.pmod(F.xxhash64(source_id), F.lit(folders)).cast("int")


def _stored(spark: SparkSession, path: str, schema: T.StructType, folders: list[int]) -> DataFrame:
    """Stored rows in the given folders; an empty table before the first batch."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(F.col("folder").isin(folders))


def stream_ingest(texts: DataFrame, chunk_path: str, vector_path: str, checkpoint: str,
                  dimensions: int = EMBEDDING_DIMENSIONS, embedder: Embedder | None = None,
                  prepare: Callable[[DataFrame], DataFrame] | None = None, folders: int = FOLDERS) -> StreamingQuery:
    """Run the batch functions on every micro-batch of ``texts(source_id, bot_id, organization_id, text)``.

    ``prepare`` turns raw stream rows into such texts. The anti joins against what is stored make a repeated batch add
    nothing, so the tables end as if each source had been handled once. Tables are kept in folders by a hash of the
    source, and a batch reads only the folders that its own sources fall into, however large the tables have grown.
    """
    spark = texts.sparkSession

    def add(batch: DataFrame, batch_id: int) -> None:
        ready = prepare(batch) if prepare else batch
        chunks = chunk_provenance(chunk_documents(ready.select("source_id", "bot_id", "organization_id", "text"))
                                  .drop("start")).withColumn("folder", folder_of(F.col("source_id"), folders))
        made = materialize(chunks, "batch")
        touched = [r["folder"] for r in made.select("folder").distinct().collect()]  # at most ``folders`` numbers
        fresh = materialize(dedupe_chunk_inserts(made, _stored(spark, chunk_path, made.schema, touched)), "fresh")
        vector_schema = T.StructType([made.schema["document_id"],
                                      T.StructField("embedding", T.ArrayType(T.FloatType())),
                                      T.StructField("deleted_at", T.TimestampType()), made.schema["folder"]])
        # Vectors first, then chunks, so a stored chunk is active and has its vector. A batch that died in between finds
        # the vectors when it is repeated and adds the chunks. Of what is stored only keys and ids are read.
        pending = chunks_without_embedding(fresh, _stored(spark, vector_path, vector_schema, touched))
        vectors = embed(pending.select("document_id", "content", "folder"), "content", "embedding", dimensions, embedder)
        (vectors.select("document_id", "embedding", F.lit(None).cast("timestamp").alias("deleted_at"), "folder")
         .hint("rebalance", "folder").write.mode("append").partitionBy("folder").parquet(vector_path))
        (fresh.withColumn("is_active", F.lit(True)).hint("rebalance", "folder")
         .write.mode("append").partitionBy("folder").parquet(chunk_path))

    return (texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_sources(sources: DataFrame, store: Store, landed: Callable[[], tuple[DataFrame, DataFrame, DataFrame, DataFrame]],
                   checkpoint: str, **options) -> StreamingQuery:
    """Take in a stream of training sources, pages and files alike, through all checks and gates of :func:`ingest`.

    ``landed`` gives the tables of pages, file records, stored objects and file parts as they are when a batch starts. Every
    micro-batch becomes one version of the store, published under the id of the query, which the checkpoint keeps, and the
    number of the batch. A batch that died before is made again; one that died after adds nothing; and with a new
    checkpoint the keys of stored chunks keep sources that come again from being stored twice. Sources that fail go to
    the table of dead letters with their message, and never stop the others.
    """
    spark = sources.sparkSession

    def add(batch: DataFrame, batch_id: int) -> None:
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        if not store.has_batch(writer, batch_id):
            ingest_into(store, materialize(batch, "batch"), *landed(), writer=writer, batch=batch_id, **options)

    return (sources.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

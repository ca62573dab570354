"""The whole way from sources to vectors."""

from pyspark.sql import functions as F

from ragtables.catalog.sources import _corpus
from ragtables.functions.text import clean_text
from ragtables.operators.chunking import split_text
from ragtables.operators.training import activate_chunks
from ragtables.plans.ingest import ingest
from ragtables.session import scratch_path
from ragtables.sources.sinks import write_chunks, write_embeddings, write_snapshot
from tests.conftest import plan

NO_CHUNKS = ("source_id string, chunk_index int, embedding_model string, embedding_version string")


def test_second_run_adds_nothing(spark, sf):
    corpus = _corpus(spark, sf)
    none = spark.createDataFrame([], NO_CHUNKS)
    no_vectors = spark.createDataFrame([], "document_id string, deleted_at timestamp")
    first = ingest(*corpus, none, no_vectors, dimensions=64)
    assert first.chunks.count() == first.vectors.count() > 0
    bad = first.results.filter("error_message IS NOT NULL").select("source_id")
    assert bad.count() > 0 and first.chunks.join(bad, "source_id").count() == 0
    good = first.results.filter("error_message IS NULL")
    assert first.chunks.select("source_id").distinct().count() == good.count()

    # Chunks of a document are those of its parts' joined text.
    parts = corpus[4].withColumn("text", clean_text(F.col("text"))).filter("text <> ''").collect()
    texts = {}
    for p in sorted(parts, key=lambda p: (p.file_id, p.part_no)):
        texts.setdefault(f"d{p.file_id}", []).append(p.text)
    got = {}
    for c in sorted(first.chunks.filter("source_id LIKE 'd%'").collect(), key=lambda c: c.chunk_index):
        got.setdefault(c.source_id, []).append(c.content)
    for source, chunks in got.items():
        assert chunks == [c for _, c in split_text("\n\n".join(texts[source]))]

    stored = first.vectors.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    second = ingest(*corpus, first.chunks, stored, dimensions=64)
    assert second.chunks.count() == 0 and second.vectors.count() == 0
    active = activate_chunks(first.chunks, first.vectors)
    assert active.filter("NOT is_active").count() == 0


def test_files_in_slices_give_the_same_chunks(spark, sf):
    corpus = _corpus(spark, sf)
    none = spark.createDataFrame([], NO_CHUNKS)
    no_vectors = spark.createDataFrame([], "document_id string, deleted_at timestamp")
    whole = ingest(*corpus, none, no_vectors, dimensions=8).chunks
    sliced = ingest(*corpus, none, no_vectors, dimensions=8, max_whole_chars=3000).chunks
    columns = ["source_id", "chunk_index", "content"]
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, sliced.select(*columns).collect()))


def test_sinks(spark):
    path = scratch_path(spark, "sinks")
    chunks = spark.range(100).selectExpr("CAST(id % 3 AS INT) AS bot_id", "CAST(id AS STRING) AS document_id")
    write_chunks(chunks, f"{path}/chunks")
    write_chunks(chunks.limit(0), f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks")
    assert stored.count() == 100
    assert "PartitionFilters: [isnotnull(bot_id" in plan(stored.filter("bot_id = 1"))
    write_embeddings(chunks, f"{path}/vectors")
    write_embeddings(chunks, f"{path}/vectors")
    assert spark.read.parquet(f"{path}/vectors").count() == 200
    new = write_snapshot(chunks, path, 7)
    assert new.endswith("v00000007") and spark.read.parquet(new).count() == 100


def test_stream_equals_batch_and_restart_adds_nothing(spark, sf):
    from ragtables.operators.chunking import chunk_documents
    from ragtables.streaming.ingest import stream_ingest

    base = scratch_path(spark, "stream")
    documents = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("source_id"), F.lit(1).alias("bot_id"), F.lit("o").alias("organization_id"), "text")
    halves = documents.randomSplit([0.5, 0.5], seed=1)

    def take_in(share):
        share.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream_ingest(spark.readStream.schema(documents.schema).parquet(f"{base}/in"), f"{base}/chunks",
                      f"{base}/vectors", f"{base}/checkpoint", dimensions=16, folders=4).awaitTermination()

    take_in(halves[0])
    take_in(halves[1])
    take_in(halves[0])  # the same sources again
    got = spark.read.parquet(f"{base}/chunks").select("source_id", "chunk_index", "content").collect()
    want = chunk_documents(documents).select("source_id", "chunk_index", "content").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    vectors = spark.read.parquet(f"{base}/vectors")
    assert vectors.count() == len(want) == vectors.select("document_id").distinct().count()


def test_batches_read_only_the_folders_of_their_sources(spark):
    from ragtables.streaming.ingest import _stored, folder_of

    path = scratch_path(spark, "folders")
    rows = spark.range(50).withColumn("folder", folder_of(F.col("id"), 8))
    assert _stored(spark, path, rows.schema, [1]).count() == 0
    rows.write.partitionBy("folder").parquet(path)
    stored = _stored(spark, path, rows.schema, [1, 5])
    assert "PartitionFilters: [folder" in plan(stored)
    assert sorted(r.id for r in stored.collect()) == sorted(r.id for r in rows.filter("folder IN (1, 5)").collect())


def test_html_is_never_shuffled(spark, sf):
    from ragtables.plans.ingest import landed_page_texts

    sources, pages = _corpus(spark, sf)[:2]
    urls = sources.filter("type = 'url'")
    few = many = landed_page_texts(urls, pages)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    for df in (few, many):
        # Between the parser and the scan there is no exchange but the one that gives a one-file table more tasks.
        below = plan(df).split("_page_text(")[-1]
        below = below[:below.index("FileScan")].split("\n")
        exchanges = [line for line in below if "Exchange" in line and "BroadcastExchange" not in line]
        assert all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_null_texts_embed_to_zero_vectors(spark):
    from ragtables.operators.embedding import embed

    rows = embed(spark.createDataFrame([(1, None), (2, "a b")], "id int, t string"), "t", "v", 8).orderBy("id").collect()
    assert sum(map(abs, rows[0].v)) == 0 and sum(map(abs, rows[1].v)) > 0


def test_ingested_rows_are_active_and_have_all_that_retrieval_needs(spark, sf):
    """What ingestion returns is searched without any column set by hand."""
    from ragtables.operators.retrieval import retrieve_topk
    from ragtables.plans.ingest import ingest

    none = spark.createDataFrame([], "source_id string, chunk_index int, embedding_model string, embedding_version string")
    vectors = spark.createDataFrame([], "document_id string, embedding array<float>, deleted_at timestamp")
    sources, pages, files, objects, parts = _corpus(spark, sf)
    done = ingest(sources.filter("type = 'url'"), pages, files, objects, parts, none, vectors, dimensions=64)
    chunks, made = done.chunks.cache(), done.vectors.cache()
    queries = made.join(chunks.select("document_id", "bot_id"), "document_id").select(
        F.col("document_id").alias("query_id"), "bot_id", F.col("embedding").alias("query_embedding"))
    best = retrieve_topk(queries, chunks, made, k=1, max_distance=0.5).collect()
    assert len(best) == queries.filter("aggregate(query_embedding, 0F, (s, x) -> s + x * x) > 0").count() > 0
    assert max(r.distance for r in best) < 1e-6

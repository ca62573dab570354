"""Scans, landed pages, uploaded files, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtables.catalog import query
from ragtables.catalog.chunk_sql import chunk_sql
from ragtables.catalog.fixtures import stream, view
from ragtables.catalog.text import CHUNKED, FULL_SQL, MAIN_SQL, clean_sql
from ragtables.functions.text import clean_text
from ragtables.operators.chunking import chunk_documents
from ragtables.operators.long_files import chunk_parts
from ragtables.operators.training import chunk_provenance
from ragtables.session import materialize, scratch_path, spread
from ragtables.sources import files as S
from ragtables.sources.pages import judge_pages
from ragtables.sources.tables import scan


@query("scan_tables", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000""")
def scan_tables(spark, sf):
    wanted = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000)
    return scan(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"], wanted)


@query("admit_pages", """
    SELECT page_id, CASE WHEN status_code >= 400 THEN 'Failed to fetch URL (status=' || CAST(status_code AS STRING) || ')'
                         WHEN content_type <> '' AND content_type NOT LIKE '%html%'
                             THEN 'Unsupported content-type: ' || content_type ELSE 'admitted' END AS verdict
    FROM v_fetched_pages""")
def admit_pages(spark, sf):
    judged = judge_pages(view(spark, sf, "v_fetched_pages").drop("html"))
    return judged.select("page_id", F.coalesce("reason", F.lit("admitted")).alias("verdict"))


@query("route_files", """
    SELECT file_id, extension, CASE extension WHEN '.pdf' THEN 'pages' WHEN '.csv' THEN 'csv' WHEN '.md' THEN 'text'
                               WHEN '.txt' THEN 'text' ELSE 'Unsupported file type' END AS reader
    FROM (SELECT file_id, CASE
              WHEN original_filename = 'a.PDF' THEN '.pdf' WHEN original_filename = 'b.csv' THEN '.csv'
              WHEN original_filename = 'c.tar.md' THEN '.md' WHEN original_filename = 'd.docx' THEN '.docx'
              WHEN mime_type = 'application/pdf' THEN '.pdf'
              WHEN lower(trim(mime_type)) LIKE 'text/csv;%' THEN '.csv' ELSE '' END AS extension FROM v_files) x""")
def route_files(spark, sf):
    routed = S.route_files(view(spark, sf, "v_files"))
    return routed.select("file_id", "extension", F.coalesce("reader", "reason").alias("reader"))


def _parts(spark, sf):
    return view(spark, sf, "conversations").select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("part_no"), "text")


MERGED = """SELECT conv_id AS file_id, string_agg(text, chr(10)||chr(10) ORDER BY turn) AS text
            FROM conversations WHERE text <> '' GROUP BY conv_id"""


@query("merge_parts", f"""
    SELECT file_id, length(text) AS n_chars, sha256(text) AS text_hash FROM ({MERGED}) x""")
def merge_parts(spark, sf):
    return S.merge_parts(_parts(spark, sf)).select(
        "file_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


def _cleaned_parts(spark, sf):
    return materialize(_parts(spark, sf).withColumn("text", clean_text(F.col("text"))), "parts").filter("text <> ''")


PARTS_CHUNKED = f"""
    WITH RECURSIVE {chunk_sql(f"SELECT file_id AS doc, {clean_sql('text')} AS text FROM ({MERGED}) m")}
    SELECT doc AS file_id, chunk_index, content FROM chunks"""


@query("chunk_parts", PARTS_CHUNKED)
def chunk_file_parts(spark, sf):
    """Conversations as files of one part per turn, joined and chunked whole."""
    return chunk_parts(_cleaned_parts(spark, sf))


@query("chunk_long_files", PARTS_CHUNKED)
def chunk_long_files(spark, sf):
    """The same in slices, the form for files that are too long to be joined, forced by a bound of zero."""
    return chunk_parts(_cleaned_parts(spark, sf), max_whole_chars=0, slices=8)


@query("read_page_parts", """
    SELECT conv_id AS file_id, turn AS part_no, length(text) AS n_chars FROM conversations WHERE text <> ''""")
def read_page_parts(spark, sf):
    landed = view(spark, sf, "conversations").select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("page_no"), "text")
    return S.read_page_parts(landed).select("file_id", "part_no", F.length("text").alias("n_chars"))


@query("read_text_files", f"""
    SELECT file_id, length(text) + 1 AS n_chars, sha256(text || chr(10)) AS text_hash FROM ({MERGED}) x""")
def read_text_files(spark, sf):
    """The conversations as one text file each, written and read back whole."""
    path = scratch_path(spark, "texts")
    # A file costs the same whatever its length, so tasks are dealt by number and not pooled by bytes.
    dealt = _parts(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism, "file_id")
    merged = S.merge_parts(dealt).select("file_id", "text")
    # Tasks put their files in place themselves, and a task lists one of a few folders, not one per file.
    folder = F.pmod(F.xxhash64("file_id"), F.lit(64))
    merged.withColumn("folder", folder).write.partitionBy("folder", "file_id").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    texts = S.read_text_files(spark, path)
    file_id = F.regexp_extract("path", r"file_id=(\d+)/", 1).cast("long")
    return texts.select(file_id.alias("file_id"), F.length("text").alias("n_chars"),
                        F.sha2("text", 256).alias("text_hash"))


@query("read_csv_files", r"""
    SELECT doc_id, sha256('doc_id: ' || CAST(doc_id AS STRING) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'lang: ' || lang
                          ELSE 'n_chars: ' || CAST(n_chars AS STRING) || chr(10) || 'source: ' || source END || chr(10)
                          || 'text: ' || regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_hash FROM documents""")
def read_csv_files(spark, sf):
    """The documents as CSV files with two kinds of headers and texts over several lines, written and read back."""
    from ragtables.sources.csv_files import read_csv_parts

    path = scratch_path(spark, "csv")
    documents = spread(view(spark, sf, "documents"), "doc_id")
    for part, columns in ((0, ["doc_id", "lang", "text"]), (1, ["doc_id", "n_chars", "source", "text"])):
        (documents.filter(F.col("doc_id") % 2 == part).select(*columns).write.mode("append")
         .csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return read_csv_parts(spark, path).select(
        F.regexp_extract("text", r"^doc_id: (\d+)", 1).cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_hash"))


@query("read_csv_as_text", """
    SELECT 'c_custkey: ' || CAST(c_custkey AS STRING) || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_nationkey: '
           || CAST(c_nationkey AS STRING) || chr(10) || 'c_mktsegment: ' || c_mktsegment AS text FROM customer""")
def read_csv_as_text(spark, sf):
    """Customers written as CSV files and read back as one text per record."""
    path, columns = scratch_path(spark, "csv"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    view(spark, sf, "customer").select(*columns).write.csv(path, header=True)
    return S.read_csv_as_text(spark, path, columns).select("text")


def _file_sources(spark, sf):
    sources = view(spark, sf, "v_sources").filter("type = 'file' AND source_value IS NOT NULL")
    return sources.select("source_id", F.lit("bot-files").alias("bucket"), F.col("source_value").alias("path"))


@query("storage_presence", """
    SELECT source_id, path, path IN (SELECT path FROM v_objects) AS is_present FROM
    (SELECT source_id, source_value AS path FROM v_sources WHERE type = 'file' AND source_value IS NOT NULL) x""")
def storage_presence(spark, sf):
    wanted, objects = _file_sources(spark, sf), view(spark, sf, "v_objects")
    there = S.present(wanted, objects).withColumn("is_present", F.lit(True))
    gone = S.missing(wanted, objects).withColumn("is_present", F.lit(False))
    return there.unionByName(gone).select("source_id", "path", "is_present")


@query("list_objects", """
    SELECT 'customers' AS bucket, 'segment=' || c_mktsegment AS folder, count(DISTINCT c_mktsegment) AS n FROM customer
    GROUP BY c_mktsegment""")
def list_objects(spark, sf):
    """Folders of a listing of files that hold the customers by market segment."""
    path = scratch_path(spark, "listing")
    customers = view(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    customers.repartition("segment").write.partitionBy("segment").parquet(path)
    objects = S.list_objects(spark, path, "customers").filter(F.col("path").startswith("segment="))
    folder = F.split_part("path", F.lit("/"), F.lit(1))
    return objects.groupBy("bucket", folder.alias("folder")).agg(F.countDistinct(folder).alias("n"))


def _new_chunks(spark, sf):
    documents = view(spark, sf, "documents").select(
        F.col("doc_id").alias("source_id"), (F.col("doc_id") % 10).cast("int").alias("bot_id"), "text")
    cleaned = spread(documents, "source_id").withColumn("text", clean_text(F.col("text")))
    return chunk_provenance(chunk_documents(cleaned).drop("start"))


@query("write_chunks", f"""
    {CHUNKED}
    SELECT CAST(doc % 10 AS INT) AS bot_id, false AS is_active, 'v.1.0.0' AS embedding_version, count(*) AS n_chunks,
           count(DISTINCT doc) AS n_sources, CAST(sum(length(content)) AS BIGINT) AS n_chars
    FROM chunks GROUP BY doc % 10""")
def write_chunks(spark, sf):
    """Chunks of all documents written in folders per bot and read back."""
    from ragtables.sources.sinks import write_chunks as write

    path = scratch_path(spark, "chunks")
    write(_new_chunks(spark, sf), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("bot_id", "is_active", "embedding_version").agg(
        F.count("*").alias("n_chunks"), F.countDistinct("source_id").alias("n_sources"),
        F.sum(F.length("content")).alias("n_chars"))


@query("write_embeddings", """
    SELECT document_id, 1536 AS dimensions FROM v_chunks c WHERE NOT EXISTS
        (SELECT 1 FROM v_embeddings e WHERE e.document_id = c.document_id AND e.deleted_at IS NULL)""")
def write_embeddings(spark, sf):
    """Vectors of the chunks that lack one, appended to a table and read back."""
    from ragtables.operators.embedding import embed_chunks
    from ragtables.sources.sinks import write_embeddings as write

    path = scratch_path(spark, "vectors")
    write(embed_chunks(view(spark, sf, "v_chunks"), view(spark, sf, "v_embeddings")), path)
    return spark.read.parquet(path).select("document_id", F.size("embedding").alias("dimensions"))


# Text or error of every source of _corpus.
SOURCE_TEXTS = f"""
    SELECT 'p' || CAST(page_id AS STRING) AS source_id, 'url' AS type,
           CASE WHEN status_code >= 400 THEN 'Failed to fetch URL (status=' || CAST(status_code AS STRING) || ')'
                WHEN content_type <> '' AND content_type NOT LIKE '%html%'
                    THEN 'Unsupported content-type: ' || content_type
                WHEN length(m) < 200 AND length(f) < 200
                    THEN 'Page content too short after fallback extraction/cleaning' ELSE '' END AS error_message,
           CASE WHEN status_code >= 400 OR (content_type <> '' AND content_type NOT LIKE '%html%') THEN ''
                WHEN length(m) >= 200 THEN m WHEN length(f) >= 200 THEN f ELSE '' END AS text
    FROM (SELECT *, {clean_sql(MAIN_SQL)} AS m, {clean_sql(FULL_SQL)} AS f FROM v_fetched_pages) x
    UNION ALL
    SELECT 'd' || CAST(doc_id AS STRING), 'file', CASE WHEN length(t) < 50
               THEN 'File content too short after loading the data from file' ELSE '' END, t
    FROM (SELECT doc_id, {clean_sql("replace(text, '. ', '.' || chr(10) || chr(10))")} AS t FROM documents) y"""


@query("ingest_union", f"SELECT source_id, type, error_message, length(text) AS n_chars FROM ({SOURCE_TEXTS}) z")
def ingest_union(spark, sf):
    """Sources of all pages and all documents, by both branches, to the length or the error of each."""
    from ragtables.plans.ingest import ingest_union as texts

    return texts(*_corpus(spark, sf)).sources.select(
        "source_id", "type", F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def _corpus(spark, sf):
    """Pages as URL sources, documents as file sources with a file record, a stored object and a part per sentence."""
    pages, documents = view(spark, sf, "v_fetched_pages"), view(spark, sf, "documents")
    urls = pages.select(F.concat(F.lit("p"), "page_id").alias("source_id"), (F.col("page_id") % 10).alias("bot_id"),
                        F.lit("org").alias("organization_id"), F.lit("url").alias("type"),
                        F.col("url").alias("source_value"))
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id"))
    others = documents.select(F.concat(F.lit("d"), "doc_id").alias("source_id"), (F.col("doc_id") % 10).alias("bot_id"),
                              F.lit("org").alias("organization_id"), F.lit("file").alias("type"),
                              path.alias("source_value"))
    files = documents.select(F.col("doc_id").alias("file_id"), F.lit("bot-files").alias("bucket"), path.alias("path"),
                             F.concat("source", F.lit(".txt")).alias("original_filename"),
                             F.lit(None).cast("string").alias("mime_type"))
    sentences = F.posexplode(F.split("text", r"(?<=[.]) "))
    parts = spread(documents, "doc_id").select(F.col("doc_id").alias("file_id"), sentences.alias("part_no", "text"))
    return urls.unionByName(others), pages, files, files.select("bucket", "path"), parts


INGESTED = f"""
    WITH RECURSIVE source_texts AS ({SOURCE_TEXTS}),
    {chunk_sql("SELECT source_id AS doc, text FROM source_texts WHERE error_message = ''")}
    SELECT s.source_id, s.error_message, count(c.doc) AS n_vectors, CAST(coalesce(sum(length(c.content)), 0) AS BIGINT)
               AS n_chars
    FROM source_texts s LEFT JOIN chunks c ON c.doc = s.source_id GROUP BY s.source_id, s.error_message"""


@query("ingest", INGESTED)
def ingest(spark, sf):
    """The whole way from sources to vectors: chunks of each source with their vectors, and its outcome."""
    from ragtables.plans.ingest import ingest as run

    chunks = view(spark, sf, "v_chunks").withColumn("source_id", F.col("source_id").cast("string"))
    vectors = view(spark, sf, "v_embeddings").withColumn("document_id", F.col("document_id").cast("string"))
    done = run(*_corpus(spark, sf), stored_chunks=chunks, stored_vectors=vectors)
    per_source = (done.chunks.join(done.vectors.select("document_id"), "document_id").groupBy("source_id")
                  .agg(F.count("*").alias("n_vectors"), F.sum(F.length("content")).alias("n_chars")))
    return done.results.join(per_source, "source_id", "left").select(
        "source_id", F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


@query("stream_sources", INGESTED)
def stream_sources(spark, sf):
    """Sources of both kinds as a stream: two files, then a restart with a third and the first again."""
    from ragtables.plans.ingest import newest_outcomes
    from ragtables.sources.snapshots import Store
    from ragtables.streaming.ingest import stream_sources as run

    base = scratch_path(spark, "sources")
    sources, *landed = _corpus(spark, sf)
    rows = sources.withColumn("part", F.pmod(F.xxhash64("source_id"), F.lit(3)))
    store = Store(spark, f"{base}/store")
    for parts in ((0, 1), (2, 0)):
        for part in parts:
            rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")
        arrived = spark.readStream.schema(sources.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        run(arrived, store, lambda: landed, f"{base}/checkpoint", dimensions=64).awaitTermination()
    chunks = store.read("chunks").join(store.read("vectors").select("document_id"), "document_id")
    per_source = chunks.groupBy("source_id").agg(F.count("*").alias("n_vectors"), F.sum(F.length("content")).alias("n_chars"))
    return newest_outcomes(store).join(per_source, "source_id", "left").select(
        "source_id", F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


@query("ingest_and_retrieve", f"SELECT source_id, 1 AS rank, 0.0 AS distance FROM ({SOURCE_TEXTS}) z WHERE error_message = ''")
def ingest_and_retrieve(spark, sf):
    """From sources to passages: all is taken into a store, and the first chunk of each source is looked for in what the store gives."""
    from ragtables.operators.cleanup import CHUNK_CHANGES, VECTOR_CHANGES
    from ragtables.plans.ingest import ingest_into
    from ragtables.plans.retrieval import retrieve_passages
    from ragtables.sources.snapshots import Store

    store = Store(spark, scratch_path(spark, "store"))
    ingest_into(store, *_corpus(spark, sf), writer="all", batch=0)
    chunks = store.read("chunks", CHUNK_CHANGES)
    queries = chunks.filter("chunk_index = 0").select(F.col("source_id").alias("query_id"), "bot_id", F.col("content").alias("query"))
    hits = retrieve_passages(queries, chunks, store.read("vectors", VECTOR_CHANGES), k=1)
    return hits.select(F.col("query_id").alias("source_id"), "rank", F.abs(F.round("distance", 6)).alias("distance"))


@query("stream_ingest", f"""
    {CHUNKED}
    SELECT doc AS source_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_chars
    FROM chunks GROUP BY doc""")
def stream_ingest(spark, sf):
    """The documents as a stream, taken in to the end; chunks and vectors per source."""
    from ragtables.streaming.ingest import stream_ingest as run

    base = scratch_path(spark, "stream")
    texts = stream(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") % 10).alias("bot_id"),
                       F.lit("org").alias("organization_id"), "text")
    done = run(texts, f"{base}/chunks", f"{base}/vectors", f"{base}/checkpoint", dimensions=256, folders=8,
               prepare=lambda batch: batch.withColumn("text", clean_text(F.col("text"))))
    done.awaitTermination()
    chunks, vectors = spark.read.parquet(f"{base}/chunks"), spark.read.parquet(f"{base}/vectors")
    return (chunks.join(vectors.select("document_id"), "document_id").groupBy("source_id")
            .agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars")))

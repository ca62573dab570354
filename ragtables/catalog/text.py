"""Text functions and text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtables.catalog import query
from ragtables.catalog.chunk_sql import chunk_sql
from ragtables.catalog.fixtures import view
from ragtables.functions import text as X
from ragtables.functions.encodings import decode_bytes, detect_encoding
from ragtables.functions.names import file_extension, mime_extension
from ragtables.operators import html_text as H
from ragtables.operators.chunking import chunk_documents as chunk
from ragtables.operators.embedding import embed, embed_chunks, embed_queries
from ragtables.operators.training import chunk_provenance as provenance
from ragtables.session import materialize, spread

WS = "".join(f"chr({ord(c)})||" for c in X.WHITESPACE)[:-2]


def clean_sql(text: str) -> str:
    """The cleaning steps for DuckDB, without NFKC, which it lacks and which changes nothing in the test texts."""
    out = f"replace({text}, chr(0), '')"
    out = f"replace(replace({out}, chr(13)||chr(10), chr(10)), chr(13), chr(10))"
    out = f"replace(replace({out}, chr(8203), ''), chr(65279), '')"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n[ \\t]+', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10)||chr(10), 'g')"
    out = f"list_transform(string_split({out}, chr(10)), lambda l: trim(l, {WS}))"
    out = f"list_filter({out}, lambda l: l = '' OR (length(l) >= 3 AND regexp_matches(l, '[\\p{{L}}\\p{{N}}]')))"
    out = f"regexp_replace(array_to_string({out}, chr(10)), '\\n{{3,}}', chr(10)||chr(10), 'g')"
    return f"trim({out}, {WS})"


@query("clean_text", f"""
    SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_hash FROM (SELECT doc_id, {clean_sql('text')} AS t
                                                                        FROM documents) x""")
def clean_text(spark, sf):
    cleaned = spread(view(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", X.clean_text(F.col("text")).alias("t"))
    return cleaned.select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_hash"))


# Texts that every cleaning step changes, made from the documents.
DIRTY = """
    chr(65279) || ' ' || replace(replace(text, '. ', ' .' || chr(13) || chr(10) || chr(9) || ' ' || chr(8203)),
        ', ', chr(13) || '--' || chr(10) || 'ab' || chr(10) || chr(10) || chr(10) || chr(10) || '   ' || chr(160))
    || chr(9)"""


@query("clean_dirty_text", f"""
    SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_hash
    FROM (SELECT doc_id, {clean_sql(f"replace({DIRTY}, chr(160), ' ')")} AS t FROM documents) x""")
def clean_dirty_text(spark, sf):
    """The same texts with marks, tabs, carriage returns, noise lines, blank lines and no-break spaces put in."""
    dirty = spread(view(spark, sf, "documents"), "doc_id").select(
        "doc_id", F.expr(DIRTY.replace("chr(65279)", "'﻿'").replace("chr(8203)", "'​'")
                         .replace("chr(160)", "' '")).alias("text"))
    cleaned = dirty.select("doc_id", X.clean_text(F.col("text")).alias("t"))
    return cleaned.select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_hash"))


@query("count_tokens", r"""
    SELECT doc_id, len(regexp_extract_all(text, '\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+')) AS n_tokens FROM documents""")
def count_tokens(spark, sf):
    documents = spread(view(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return documents.select("doc_id", X.count_tokens(F.col("text")).alias("n_tokens"))


try:
    import public_tokenizers
except ImportError:
    public_tokenizers = None

if public_tokenizers is not None:

    @query("count_tokens_vocabulary")
    def count_tokens_vocabulary(spark, sf):
        """Tokens by a byte-pair vocabulary that is installed on the workers."""
        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
        counter = X.bpe_token_counter(ranks, public_tokenizers.PATTERN)
        documents = spread(view(spark, sf, "documents").select("doc_id", "text"), "doc_id")
        return documents.select("doc_id", counter(F.col("text")).alias("n_tokens"))


@query("file_extension", r"""
    SELECT file_id, CASE original_filename WHEN 'a.PDF' THEN '.pdf' WHEN 'b.csv' THEN '.csv' WHEN 'c.tar.md' THEN '.md'
                    WHEN 'd.docx' THEN '.docx' ELSE '' END AS extension FROM v_files""")
def extension(spark, sf):
    return view(spark, sf, "v_files").select("file_id", file_extension(F.col("original_filename")).alias("extension"))


@query("mime_extension", """
    SELECT file_id, coalesce(CASE string_split(lower(trim(mime_type)), ';')[1]
        WHEN 'application/pdf' THEN '.pdf' WHEN 'text/csv' THEN '.csv' WHEN 'text/plain' THEN '.txt'
        WHEN 'text/markdown' THEN '.md' WHEN 'text/x-markdown' THEN '.md' END, '') AS extension FROM v_files""")
def mime(spark, sf):
    known = F.coalesce(mime_extension(F.col("mime_type")), F.lit(""))
    return view(spark, sf, "v_files").select("file_id", known.alias("extension"))


@query("address_json", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def address_json(spark, sf):
    """A path of a JSON column, read through the variant type."""
    events = view(spark, sf, "events")
    return events.select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


def unescape_sql(text: str) -> str:
    for entity, char in (("&copy;", 169), ("&middot;", 183), ("&quot;", 34), ("&amp;", 38)):
        text = f"replace({text}, '{entity}', chr({char}))"
    return text


# The test pages are plain enough for regular expressions: one article, and none of its classes is junk. An entity
# that a tag cuts short has no semicolon but counts.
HTML = "replace(html, '&amp<', '&amp;<')"
STRINGS = f"""list_filter(string_split(regexp_replace(
        regexp_extract({HTML}, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', chr(1), 'g'), chr(1)), lambda s: s <> '')"""
MAIN_SQL = f"trim(array_to_string(list_transform({STRINGS}, lambda s: {unescape_sql('s')}), chr(10)), {WS})"
BARE_SQL = f"regexp_replace({HTML}, '<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', '', 'gs')"
FULL_SQL = unescape_sql(BARE_SQL)


def _extracted(spark, sf):
    return H.extract_text(spread(view(spark, sf, "pages"), "page_id"))


@query("extract_main_text", f"""
    SELECT page_id, 'article' AS root_used, len(regexp_extract_all(html, '<(script|style|nav|footer)')) AS n_removed,
           length(t) AS n_chars, sha256(t) AS text_hash
    FROM (SELECT *, {MAIN_SQL} AS t FROM pages) x""")
def extract_main_text(spark, sf):
    return _extracted(spark, sf).select(
        "page_id", "root_used", "n_removed", F.length("main_text").alias("n_chars"),
        F.sha2("main_text", 256).alias("text_hash"))


@query("extract_full_text", f"""
    SELECT page_id, length(t) AS n_chars, sha256(t) AS text_hash FROM (SELECT page_id, {FULL_SQL} AS t FROM pages) x""")
def extract_full_text(spark, sf):
    return _extracted(spark, sf).select("page_id", F.length("full_text").alias("n_chars"),
                                        F.sha2("full_text", 256).alias("text_hash"))


@query("page_text_with_fallback", f"""
    SELECT page_id, CASE WHEN length(m) >= 200 THEN 'primary' WHEN length(f) >= 200 THEN 'fallback' ELSE 'none' END
               AS method, length(m) AS main_chars,
           CASE WHEN length(m) >= 200 THEN sha256(m) WHEN length(f) >= 200 THEN sha256(f) ELSE '' END AS text_hash
    FROM (SELECT page_id, {clean_sql(MAIN_SQL)} AS m, {clean_sql(FULL_SQL)} AS f FROM pages) x""")
def page_text_with_fallback(spark, sf):
    texts = H.page_text_with_fallback(_extracted(spark, sf))
    return texts.select("page_id", "method", "main_chars",
                        F.coalesce(F.sha2("text", 256), F.lit("")).alias("text_hash"))


def _chunks(spark, sf):
    documents = spread(view(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return chunk(documents.select("doc_id", X.clean_text(F.col("text")).alias("text")))


CHUNKED = f"WITH RECURSIVE {chunk_sql(f'SELECT doc_id AS doc, {clean_sql('text')} AS text FROM documents')}"


@query("chunk_documents", f"{CHUNKED} SELECT doc AS doc_id, chunk_index, content FROM chunks")
def chunk_documents(spark, sf):
    return _chunks(spark, sf).drop("start")


@query("chunk_numbering", f"""
    {CHUNKED}
    SELECT doc AS doc_id, count(*) AS n_chunks, 0 AS first_index, count(*) - 1 AS last_index, count(*) AS n_indexes
    FROM chunks GROUP BY doc""")
def chunk_numbering(spark, sf):
    """Chunks per document; the numbers run from 0 without a gap."""
    return _chunks(spark, sf).groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.min("chunk_index").alias("first_index"),
        F.max("chunk_index").alias("last_index"), F.countDistinct("chunk_index").alias("n_indexes"))


@query("chunk_provenance", r"""
    SELECT sha256(source_id || '|' || CAST(chunk_index AS STRING) || '|text-embedding-3-small|v.1.0.0') AS document_id,
           800 AS chunk_size, 100 AS chunk_overlap, false AS is_active, 'text-embedding-3-small' AS embedding_model,
           'v.1.0.0' AS embedding_version, 'openai' AS embedding_provider, '' AS deleted_at,
           len(regexp_extract_all(content, '\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+')) AS token_count
    FROM v_chunks""")
def chunk_provenance(spark, sf):
    rows = provenance(view(spark, sf, "v_chunks").select("source_id", "chunk_index", "content"))
    return rows.select("document_id", "chunk_size", "chunk_overlap", "is_active", "embedding_model", "embedding_version",
                       "embedding_provider", "token_count", F.coalesce(F.col("deleted_at").cast("string"), F.lit("")).alias("deleted_at"))


def _vector_facts(df, key, vector):
    squares = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    return df.select(key, F.size(vector).alias("dimensions"), F.round(squares, 4).alias("squared_length"))


LENGTH = r"CAST(CASE WHEN regexp_matches(content, '[\p{L}\p{N}]') THEN 1 ELSE 0 END AS DOUBLE) AS squared_length"


@query("embed_chunks", f"""
    SELECT document_id, 1536 AS dimensions, {LENGTH} FROM v_chunks c WHERE NOT EXISTS
        (SELECT 1 FROM v_embeddings e WHERE e.document_id = c.document_id AND e.deleted_at IS NULL)""")
def embedded_chunks(spark, sf):
    """Vectors of the chunks that have none; length 1 unless the text has no word."""
    vectors = embed_chunks(spread(view(spark, sf, "v_chunks"), "document_id"), view(spark, sf, "v_embeddings"))
    return _vector_facts(vectors, "document_id", "embedding")


@query("embed_queries", f"""
    SELECT message_id AS query_id, 1536 AS dimensions, {LENGTH} FROM v_messages WHERE role = 'user'""")
def embedded_queries(spark, sf):
    users = view(spark, sf, "v_messages").filter("role = 'user'")
    queries = users.select(F.col("message_id").alias("query_id"), F.col("content").alias("query"))
    return _vector_facts(embed_queries(queries), "query_id", "query_embedding")


@query("retrieve_passages")
def retrieve_passages(spark, sf):
    """Questions of users against the chunks of all documents, from text to ranked passages."""
    from ragtables.plans.retrieval import retrieve_passages as passages

    chunks = materialize(provenance(_chunks(spark, sf).withColumnRenamed("doc_id", "source_id").drop("start")), "chunks")
    chunks = (chunks.withColumn("bot_id", (F.col("source_id") % 10).cast("int"))
              .withColumn("deleted_at", F.lit(None).cast("timestamp")).withColumn("is_active", F.lit(True)))
    vectors = embed(chunks.select("document_id", "content"), "content", "embedding").select("document_id", "embedding")
    users = view(spark, sf, "v_messages").filter("role = 'user'")
    queries = users.select(F.col("message_id").alias("query_id"), F.col("content").alias("query"),
                           (F.col("conversation_id") % 10).cast("int").alias("bot_id"))
    hits = passages(queries, chunks, vectors, max_distance=0.9)
    return hits.select("query_id", "rank", "source_id", "chunk_index", F.round("distance", 6).alias("distance"))


#: Documents by turns in five encodings; those with letters beyond Latin-1 are not written in single bytes.
CHARSETS = ["UTF-8", "UTF-16LE", "UTF-16BE", "UTF-32", "ISO-8859-1"]


@query("detect_encoding", r"""
    SELECT doc_id, md5(coalesce(text, '')) AS text_md5,
           CASE WHEN coalesce(text, '') = '' THEN 'UTF-8' WHEN doc_id % 5 = 1 THEN 'UTF-16LE' WHEN doc_id % 5 = 2 THEN 'UTF-16BE'
                WHEN doc_id % 5 = 3 THEN 'UTF-32BE' WHEN doc_id % 5 = 4 AND regexp_full_match(text, '[\x{00}-\x{7F}\x{A0}-\x{FF}]*', 's')
                     AND NOT regexp_full_match(text, '[\x{00}-\x{7F}]*', 's') THEN 'windows-1252' ELSE 'UTF-8' END AS charset
    FROM documents""")
def detect_encoding_query(spark, sf):
    text = F.coalesce("text", F.lit(""))
    number = F.when((F.col("doc_id") % 5 == 4) & ~text.rlike(r"\A[\x00-\x7F\xA0-\xFF]*\z"), 0).otherwise(F.col("doc_id") % 5)
    content = F.coalesce(*[F.when(number == i, F.encode(text, charset)) for i, charset in enumerate(CHARSETS)])
    files = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", content.alias("content"))
    told = files.withColumn("charset", detect_encoding(F.col("content")))
    return told.select("doc_id", F.md5(decode_bytes(F.col("content"), F.col("charset")).cast("binary")).alias("text_md5"), "charset")

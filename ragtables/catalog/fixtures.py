"""Views that give the test tables the shapes of the corpus tables. The same SQL text runs on Spark and on DuckDB."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_chunks": """
        SELECT doc_id AS document_id, CAST(doc_id % 10 AS INT) AS bot_id,
               'org_' || CAST((doc_id % 10) % 3 AS STRING) AS organization_id, source AS source_id,
               CAST(doc_id % 7 AS INT) AS chunk_index, text AS content,
               'text-embedding-3-small' AS embedding_model,
               CASE WHEN CAST(floor(doc_id / 10.0) AS BIGINT) % 5 = 0 THEN 'v.0.9.0' ELSE 'v.1.0.0' END
                   AS embedding_version,
               (doc_id % 7 <> 0) AS is_active,
               CASE WHEN doc_id % 13 = 0 THEN CAST('2026-01-01 00:00:00' AS TIMESTAMP) END AS deleted_at
        FROM documents""",
    "v_embeddings": """
        SELECT vec_id AS document_id, embedding,
               CASE WHEN vec_id % 17 = 0 THEN CAST('2026-01-01 00:00:00' AS TIMESTAMP) END AS deleted_at
        FROM embeddings""",
    "v_queries": """
        SELECT vec_id AS query_id, CAST(vec_id % 10 AS INT) AS bot_id, embedding AS query_embedding
        FROM embeddings""",
    "v_jobs": """
        SELECT o_orderkey AS job_id, o_custkey AS bot_id,
               'org_' || CAST(o_custkey % 3 AS STRING) AS organization_id,
               CASE WHEN o_orderstatus = 'O' AND o_orderkey % 10 = 0 THEN 'queued'
                    WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 1 THEN 'processing'
                    ELSE 'completed' END AS status
        FROM orders""",
    "v_source_outcomes": """
        SELECT l_orderkey AS job_id, l_linenumber AS source_no, (l_returnflag <> 'R') AS ok FROM lineitem""",
    "v_sources": """
        SELECT o_orderkey AS source_id, o_custkey AS bot_id,
               'org_' || CAST(o_custkey % 3 AS STRING) AS organization_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'url' ELSE 'file' END AS type,
               CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'P' THEN 'pending' ELSE 'trained' END AS status,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL
                    WHEN o_orderkey % 2 = 1 THEN 'bot/' || CAST(CAST(floor(o_orderkey / 5.0) AS BIGINT) AS STRING)
                    WHEN o_orderkey % 6 = 0 THEN 'example.com/' || CAST(o_orderkey AS STRING)
                    ELSE 'https://h' || CAST(o_orderkey % 100 AS STRING) || '.example.com/'
                         || CAST(o_orderkey AS STRING) END AS source_value,
               CASE WHEN o_orderkey % 11 = 0 THEN CAST('2026-01-01 00:00:00' AS TIMESTAMP) END AS deleted_at
        FROM orders""",
    "v_job_sources": """
        SELECT DISTINCT l_orderkey AS job_id, l_orderkey + l_linenumber - 1 AS source_id FROM lineitem""",
    "v_files": """
        SELECT p_partkey AS file_id, 'bot-files' AS bucket,
               'bot/' || CAST(CASE WHEN p_partkey % 17 = 0 THEN p_partkey - 1 ELSE p_partkey END AS STRING) AS path,
               CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.csv' WHEN 2 THEN 'c.tar.md'
                    WHEN 3 THEN 'noext' WHEN 4 THEN '.csv' ELSE 'd.docx' END AS original_filename,
               CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN ' Text/CSV;charset=utf-8' WHEN 1 THEN 'application/pdf'
                    WHEN 2 THEN 'text/markdown ;x' ELSE NULL END AS mime_type
        FROM part""",
    "v_objects": """
        SELECT DISTINCT 'bot-files' AS bucket, 'bot/' || CAST(p_partkey + p_size % 4 AS STRING) AS path
        FROM part""",
    "v_fetched_pages": """
        SELECT page_id, url, html, CASE WHEN page_id % 20 = 0 THEN 404 ELSE 200 END AS status_code,
               CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ''
                    WHEN 2 THEN 'application/xhtml+xml' ELSE 'application/json' END AS content_type
        FROM pages""",
    "v_messages": """
        SELECT conv_id * 1000 + turn AS message_id, conv_id AS conversation_id, role, text AS content,
               CAST('2024-01-01 00:00:00' AS TIMESTAMP) + turn * INTERVAL '1' MINUTE AS created_at
        FROM conversations""",
    "v_feedback": """
        SELECT message_id, CASE WHEN message_id % 3 = 0 THEN 'negative' WHEN message_id % 31 = 1 THEN 'unknown'
                                ELSE 'positive' END AS feedback
        FROM v_messages WHERE role = 'assistant'""",
    "v_session_events": """
        SELECT event_id, user_id AS conversation_id, ts, 'org_' || CAST(user_id % 3 AS STRING) AS organization_id,
               CASE event_type WHEN 'signup' THEN 'user'
                    WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'agent' END
                    WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'agent' ELSE 'user' END
                    ELSE 'agent' END AS actor,
               CASE event_type WHEN 'signup' THEN 'connect' WHEN 'purchase' THEN 'connect'
                    WHEN 'error' THEN 'disconnect' WHEN 'view' THEN 'typing' ELSE 'message' END AS kind
        FROM events""",
    "v_mixed_events": """
        SELECT event_id, user_id AS conversation_id, ts,
               'org_' || CAST((user_id + CASE WHEN value > 100 THEN 1 ELSE 0 END) % 3 AS STRING) AS organization_id,
               CASE WHEN event_id % 3 = 0 THEN 'agent' ELSE 'user' END AS actor,
               CASE event_type WHEN 'signup' THEN 'connect' WHEN 'purchase' THEN 'connect'
                    WHEN 'error' THEN 'disconnect' WHEN 'view' THEN 'typing' ELSE 'message' END AS kind
        FROM events""",
    "v_arriving_events": """
        SELECT *, CAST(floor((day(ts) - 1 + CASE WHEN event_id % 40 = 0 THEN 12 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)
                             / 6.0) AS INT) AS batch
        FROM v_mixed_events""",
    "v_connects": """
        SELECT event_id, user_id AS conversation_id, ts,
               CASE WHEN value < 2 THEN NULL ELSE 'token' END AS token, (event_id % 11 <> 0) AS claims_valid,
               CASE WHEN event_id % 13 = 0 THEN user_id + 1 ELSE user_id END AS claim_conversation_id,
               CASE WHEN event_id % 17 = 0 THEN NULL
                    ELSE 'org_' || CAST((user_id + CASE WHEN value > 100 THEN 1 ELSE 0 END) % 3 AS STRING) END
                   AS claim_organization_id,
               CASE event_type WHEN 'signup' THEN 'user' WHEN 'error' THEN 'robot' ELSE 'agent' END AS claim_type
        FROM events""",
    "v_hashed_documents": """
        SELECT doc_id, CAST(doc_id % 10 AS INT) AS bot_id, text, doc_id IN (SELECT doc_id FROM labels) AS is_known
        FROM documents""",
    "v_configs": """
        SELECT c_custkey AS config_id, CAST(c_custkey % 10 AS INT) AS bot_id, CAST(3 + c_nationkey % 5 AS INT)
                   AS retrieval_k,
               CAST(0.5 AS DOUBLE) + c_nationkey / CAST(100 AS DOUBLE) AS similarity_threshold, (c_acctbal > 0) AS active,
               CAST('2024-01-01 00:00:00' AS TIMESTAMP) + c_nationkey * INTERVAL '1' DAY AS created_at
        FROM customer""",
    "v_raw_messages": """
        SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS content,
               CASE WHEN turn % 7 = 3 THEN 'bot' WHEN turn % 2 = 0 THEN NULL ELSE role END AS role,
               CASE WHEN conv_id % 9 = 0 THEN 'image' WHEN conv_id % 2 = 0 THEN 'file' END AS content_type,
               CASE WHEN conv_id % 10 = 7 THEN '' ELSE CAST(conv_id AS STRING) END AS conversation_id,
               CASE WHEN turn % 3 = 0 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) END AS timestamp
        FROM conversations""",
    "t_organizations": "SELECT 'org_' || CAST(n_nationkey AS STRING) AS id FROM nation",
    "t_users": """
        SELECT c_custkey AS id, c_name || '@example.com' AS email, c_mktsegment AS google_id,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS github_id, CAST(NULL AS STRING) AS microsoft_id
        FROM customer""",
    "t_bots": """
        SELECT c_custkey AS id, 'org_' || CAST(c_nationkey + CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END AS STRING)
                   AS organization_id FROM customer""",
    "t_organization_members": """
        SELECT o_orderkey AS id, 'org_' || CAST(o_custkey % 25 AS STRING) AS organization_id, o_custkey AS user_id
        FROM orders""",
    "t_organization_invites": """
        SELECT s_suppkey AS id, 'org_' || CAST(s_nationkey + s_suppkey % 3 AS STRING) AS organization_id
        FROM supplier""",
    "t_otps": """
        SELECT event_id AS id, user_id * 12 AS user_id,
               CASE event_type WHEN 'click' THEN 'EMAIL' WHEN 'view' THEN 'MOBILE' WHEN 'error' THEN 'PAGER'
                    WHEN 'signup' THEN NULL ELSE 'EMAIL' END AS type,
               CASE event_type WHEN 'click' THEN 'LOGIN' WHEN 'view' THEN 'VERIFY_EMAIL' WHEN 'error'
                    THEN 'VERIFY_PHONE' WHEN 'signup' THEN 'RESET_PASSWORD' ELSE event_type END AS purpose
        FROM events""",
    "t_api_keys": """
        SELECT s_suppkey AS id, 'org_' || CAST(s_nationkey AS STRING) AS organization_id, s_suppkey * 20 AS bot_id
        FROM supplier""",
    "t_files": """
        SELECT p_partkey AS id, 'org_' || CAST(p_size AS STRING) AS organization_id, p_partkey AS bot_id,
               CASE p_type WHEN 'ECONOMY' THEN 'uploaded' WHEN 'SMALL' THEN 'lost' ELSE 'processed' END AS status
        FROM part""",
    "t_training_sources": """
        SELECT o_orderkey AS id, 'org_' || CAST(o_custkey % 26 AS STRING) AS organization_id,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS bot_id,
               CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'P' THEN 'stuck' ELSE 'trained' END AS status
        FROM orders""",
    "t_training_jobs": """
        SELECT o_orderkey AS id, CASE o_orderpriority WHEN '5-LOW' THEN 'paused' ELSE 'completed' END AS status
        FROM orders""",
    "t_conversations_meta": """
        SELECT DISTINCT conv_id AS id, 'org_' || CAST(conv_id % 27 AS STRING) AS organization_id,
               conv_id * 17 AS bot_id, conv_id * 2 AS api_key_id FROM conversations""",
    "t_leads": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-'
                   || CAST(l_linenumber AS STRING) AS id, 'org_' || CAST(l_suppkey % 28 AS STRING) AS organization_id,
               l_partkey AS bot_id, l_suppkey AS conversation_id FROM lineitem""",
    "t_documents": """
        SELECT doc_id AS id, source AS source_id, CAST(doc_id % 700 AS INT) AS chunk_index, lang AS embedding_model,
               CASE WHEN n_chars < 1000 THEN NULL ELSE 'v.1.0.0' END AS embedding_version FROM documents""",
    "t_embeddings": "SELECT vec_id * 2 AS id, vec_id * 2 AS document_id FROM embeddings",
    "t_messages": "SELECT message_id AS id FROM v_messages",
    "t_message_feedback": "SELECT message_id AS id, message_id + message_id % 2 AS message_id, feedback FROM v_feedback",
}

_SOURCE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join((*VIEWS, *TABLES)) + r")\b", re.IGNORECASE)


_SCHEMAS = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is looked up in the file once and then kept."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream. A pattern, as the source takes a plain path for a folder and a table may be one file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name].replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")
    inputs = {source: view(spark, sf_dir, source) for _, source in _SOURCE.findall(sql)}
    return spark.sql(_SOURCE.sub(r"\1 {\2}", sql), **inputs)


def _needed(sql: str, seen: dict[str, str]) -> None:
    for _, name in _SOURCE.findall(sql):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen[name] = VIEWS[name]


def with_views(sql: str) -> str:
    """SQL text for DuckDB with the views it uses in front."""
    views: dict[str, str] = {}
    _needed(sql, views)
    if not views:
        return sql.strip()
    heads = ",\n".join(f"{name} AS ({body})" for name, body in views.items())
    body = sql.strip()
    for start in ("WITH RECURSIVE", "WITH"):
        if body.startswith(start):
            return f"{start} {heads},\n{body[len(start):].lstrip()}"
    return f"WITH {heads}\n{body}"


def tables(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The audited tables, or those of the given names."""
    names = names or [n[2:] for n in VIEWS if n.startswith("t_")]
    return {n: view(spark, sf_dir, f"t_{n}") for n in dict.fromkeys(names)}

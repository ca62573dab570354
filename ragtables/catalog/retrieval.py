"""Vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtables.catalog import query
from ragtables.catalog.fixtures import view
from ragtables.functions.vectors import cosine_distance, cosine_similarity
from ragtables.operators import retrieval as R

# The test vectors are random, so the default distance of 0.5 keeps little beside each vector itself.
WIDE = 0.9

CURRENT = """embedding_model = 'text-embedding-3-small' AND embedding_version = 'v.1.0.0'
             AND is_active AND c.deleted_at IS NULL"""

SCORED = f"""
    vectors AS (SELECT c.document_id, c.bot_id, c.chunk_index, CAST(e.embedding AS DOUBLE[]) AS v
                FROM v_chunks c JOIN v_embeddings e ON e.document_id = c.document_id WHERE {CURRENT}),
    scored AS (SELECT q.query_id, q.bot_id, v.document_id, v.chunk_index,
                      round(list_cosine_distance(CAST(q.query_embedding AS DOUBLE[]), v.v), 12) AS distance
               FROM v_queries q JOIN vectors v ON q.bot_id = v.bot_id)"""

TOPK = f"""
    WITH {SCORED},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_index, document_id) AS rank
               FROM scored WHERE distance <= {WIDE})
    SELECT query_id, CAST(rank AS INT) AS rank, document_id, chunk_index, round(distance, 6) AS distance
    FROM ranked WHERE rank <= 5"""


def _inputs(spark, sf):
    return [view(spark, sf, v) for v in ("v_queries", "v_chunks", "v_embeddings")]


def _ranked(hits):
    return hits.select("query_id", "rank", "document_id", "chunk_index", F.round("distance", 6).alias("distance"))


@query("retrieve_topk", TOPK)
def retrieve_topk(spark, sf):
    return _ranked(R.retrieve_topk(*_inputs(spark, sf), max_distance=WIDE))


@query("retrieve_topk_expression", TOPK)
def retrieve_topk_expression(spark, sf):
    return _ranked(R.retrieve_topk(*_inputs(spark, sf), max_distance=WIDE, blocked=False))


@query("retrieve_topk_tiled", TOPK)
def retrieve_topk_tiled(spark, sf):
    """The form for more queries than may be broadcast, forced by a bound of zero and small tiles."""
    return _ranked(R.retrieve_topk(*_inputs(spark, sf), max_distance=WIDE, broadcast_bytes=0, query_tile=32,
                                   vector_tile=64))


@query("embeddings_join_chunks", f"""
    SELECT c.document_id, c.bot_id, c.chunk_index, CAST(len(e.embedding) AS INT) AS dimensions
    FROM v_chunks c JOIN v_embeddings e ON e.document_id = c.document_id WHERE {CURRENT}""")
def embeddings_join_chunks(spark, sf):
    vectors = R.searchable_vectors(view(spark, sf, "v_chunks"), view(spark, sf, "v_embeddings"))
    return vectors.select("document_id", "bot_id", "chunk_index", F.size("embedding").alias("dimensions"))


@query("current_version_chunks", f"SELECT c.document_id, bot_id, chunk_index FROM v_chunks c WHERE {CURRENT}")
def current_version_chunks(spark, sf):
    return R.current_chunks(view(spark, sf, "v_chunks")).select("document_id", "bot_id", "chunk_index")


@query("retrieve_candidates", f"""
    WITH {SCORED}
    SELECT query_id, document_id, round(distance, 6) AS distance FROM scored WHERE distance <= 0.5""")
def retrieve_candidates(spark, sf):
    queries, chunks, embeddings = _inputs(spark, sf)
    hits = R.score_blocked(queries, R.searchable_vectors(chunks, embeddings), R.MAX_DISTANCE)
    return hits.select("query_id", "document_id", F.round("distance", 6).alias("distance"))


@query("distance_threshold", f"""
    WITH {SCORED}
    SELECT query_id, count(*) AS n_within, round(min(distance), 6) AS nearest FROM scored
    WHERE distance <= {WIDE} GROUP BY query_id""")
def distance_threshold(spark, sf):
    """Vectors within the distance, counted per query; the counts are combined before the shuffle."""
    queries, chunks, embeddings = _inputs(spark, sf)
    hits = R.score_pairs(queries, R.searchable_vectors(chunks, embeddings), WIDE)
    return hits.groupBy("query_id").agg(F.count("*").alias("n_within"),
                                        F.round(F.min("distance"), 6).alias("nearest"))


def _neighbours(spark, sf):
    """Each vector beside the next one."""
    a = view(spark, sf, "embeddings")
    return a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")


def neighbour_sql(function):
    return f"""
    SELECT a.vec_id, round({function}(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS value
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


@query("cosine_similarity", neighbour_sql("list_cosine_similarity"))
def similarity(spark, sf):
    value = F.round(cosine_similarity(F.col("embedding"), F.col("next")), 6)
    return _neighbours(spark, sf).select("vec_id", value.alias("value"))


@query("cosine_distance", neighbour_sql("list_cosine_distance"))
def distance(spark, sf):
    value = F.round(cosine_distance(F.col("embedding"), F.col("next")), 6)
    return _neighbours(spark, sf).select("vec_id", value.alias("value"))


@query("retrieve_one", f"""
    WITH q AS (SELECT CAST(min_by(query_embedding, query_id) AS DOUBLE[]) AS v, min_by(bot_id, query_id) AS bot_id
               FROM v_queries)
    SELECT c.document_id, c.chunk_index,
           round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), (SELECT v FROM q)), 6) AS distance
    FROM v_chunks c JOIN v_embeddings e ON e.document_id = c.document_id
    WHERE {CURRENT} AND c.bot_id = (SELECT bot_id FROM q)
      AND list_cosine_distance(CAST(e.embedding AS DOUBLE[]), (SELECT v FROM q)) <= 1.0
    ORDER BY list_cosine_distance(CAST(e.embedding AS DOUBLE[]), (SELECT v FROM q)), c.chunk_index, c.document_id
    LIMIT 5""")
def retrieve_one(spark, sf):
    queries, chunks, embeddings = _inputs(spark, sf)
    first = queries.orderBy("query_id").first()
    hits = R.retrieve_one(first["query_embedding"], first["bot_id"], chunks, embeddings, max_distance=1.0)
    return hits.select("document_id", "chunk_index", F.round("distance", 6).alias("distance"))


@query("retrieval_log_rows", f"""
    WITH {SCORED},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_index, document_id) AS rank
               FROM scored WHERE distance <= {WIDE})
    SELECT query_id, bot_id, string_agg(CAST(document_id AS STRING), ',' ORDER BY rank) AS retrieved_document_ids,
           count(*) AS n_retrieved, round(sum(1 - distance), 6) AS total_similarity, CAST({WIDE} AS DOUBLE) AS retrieval_threshold,
           5 AS retrieval_k
    FROM ranked WHERE rank <= 5 GROUP BY query_id, bot_id""")
def retrieval_log_rows(spark, sf):
    logs = R.retrieval_log_rows(R.retrieve_topk(*_inputs(spark, sf), max_distance=WIDE), max_distance=WIDE)
    total = F.aggregate("similarity_scores", F.lit(0.0), lambda a, x: a + x)
    return logs.select("query_id", "bot_id",
                       F.array_join(F.col("retrieved_document_ids").cast("array<string>"), ",")
                       .alias("retrieved_document_ids"),
                       F.size("retrieved_document_ids").cast("long").alias("n_retrieved"),
                       F.round(total, 6).alias("total_similarity"), "retrieval_threshold", "retrieval_k")


@query("active_model_config", """
    SELECT bot_id, config_id, retrieval_k, round(similarity_threshold, 6) AS similarity_threshold
    FROM (SELECT *, row_number() OVER (PARTITION BY bot_id ORDER BY created_at DESC, config_id DESC) AS n
          FROM v_configs WHERE active) x WHERE n = 1""")
def active_model_config(spark, sf):
    return R.active_model_config(view(spark, sf, "v_configs")).select(
        "bot_id", "config_id", "retrieval_k", F.round("similarity_threshold", 6).alias("similarity_threshold"))


@query("retrieve_configured", f"""
    WITH {SCORED},
    settings AS (SELECT bot_id, retrieval_k, similarity_threshold FROM
                 (SELECT *, row_number() OVER (PARTITION BY bot_id ORDER BY created_at DESC, config_id DESC) AS n
                  FROM v_configs WHERE active) x WHERE n = 1),
    ranked AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_index, document_id)
                   AS rank, coalesce(t.retrieval_k, 5) AS k
               FROM scored s LEFT JOIN settings t ON s.bot_id = t.bot_id
               WHERE distance <= coalesce(t.similarity_threshold, 0.5))
    SELECT query_id, CAST(rank AS INT) AS rank, document_id, round(distance, 6) AS distance FROM ranked
    WHERE rank <= k""")
def retrieve_configured(spark, sf):
    hits = R.retrieve_configured(*_inputs(spark, sf), view(spark, sf, "v_configs"))
    return hits.select("query_id", "rank", "document_id", F.round("distance", 6).alias("distance"))

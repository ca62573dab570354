"""Queries of term weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtables.catalog import query
from ragtables.operators.weighting import fit_term_weights, retrieve_by_terms, weigh_terms
from ragtables.session import materialize

TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

WEIGHTS = f"""
    w AS (SELECT term, count(*) AS document_frequency, ln((any_value(n) + 1.0) / (count(*) + 1.0)) + 1.0 AS weight
          FROM (SELECT DISTINCT doc_id, unnest({TERMS}) AS term FROM documents), (SELECT count(*) AS n FROM documents) GROUP BY term)"""


def vectors_sql(table: str, key: str) -> str:
    return f"""
    SELECT {key}, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {key})) AS weight
    FROM (SELECT {key}, t.term, tf, coalesce(w.weight, ln((SELECT count(*) FROM documents) + 1.0) + 1.0) AS idf
          FROM (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({TERMS}) AS term FROM {table}) GROUP BY ALL) t
          LEFT JOIN w ON w.term = t.term)"""


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")


def weights(spark, sf):
    return materialize(fit_term_weights(documents(spark, sf), "text"), "term_weights")


@query("fit_term_weights", f"""
    WITH {WEIGHTS} SELECT term, document_frequency, round(weight, 9) AS weight FROM w""")
def fit_term_weights_query(spark, sf):
    return fit_term_weights(documents(spark, sf), "text").select("term", "document_frequency", F.round("weight", 9).alias("weight"))


@query("embed_chunks_weighted", f"""
    WITH {WEIGHTS} SELECT doc_id AS document_id, term, tf, round(weight, 9) AS weight FROM ({vectors_sql("documents", "doc_id")})""")
def embed_chunks_weighted(spark, sf):
    vectors = weigh_terms(documents(spark, sf), weights(spark, sf), text="text")
    return vectors.select("document_id", "term", "tf", F.round("weight", 9).alias("weight"))


@query("retrieve_by_terms", f"""
    WITH {WEIGHTS}, d AS ({vectors_sql("documents", "doc_id")}), q AS ({vectors_sql("benchmark", "item_id")})
    SELECT query_id, rank, document_id, distance FROM (
        SELECT query_id, document_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id) AS INT) AS rank
        FROM (SELECT item_id AS query_id, doc_id AS document_id, round(1.0 - sum(d.weight * q.weight), 9) AS distance
              FROM d JOIN q USING (term) GROUP BY ALL) WHERE distance <= 0.9)
    WHERE rank <= 5""")
def retrieve_by_terms_query(spark, sf):
    fitted = weights(spark, sf)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return retrieve_by_terms(weigh_terms(items, fitted, "query_id", "text"), weigh_terms(documents(spark, sf), fitted, text="text"), 5, 0.9)

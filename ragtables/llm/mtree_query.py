"""Query of the exact search and its SQL."""

from ragtables.llm.catalog import query, table
from ragtables.llm.mtree import quantized, top_inner_products

SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op1_mtree_search", SQL)
def op1(spark, sf_dir):
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_inner_products(vectors, vectors.filter("vec_id % 20 = 0"), k=20)

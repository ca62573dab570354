"""Query of the mixing operator and its SQL, with plain window sums."""

from ragtables.llm.catalog import query, table
from ragtables.llm.mixing import mix, sized

SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM docs GROUP BY source),
-- round after round: sources above their limit are fixed at it, the others share what is left
rounds AS (
    SELECT 0 AS n, CAST(NULL AS DOUBLE) AS level
    UNION ALL
    SELECT n + 1, (SELECT ((SELECT sum(source_size) FROM sources)
               - coalesce(sum(3 * source_size) FILTER (3 * source_size <= weight * coalesce(r.level, -1)), 0))
               / nullif(sum(weight) FILTER (NOT 3 * source_size <= weight * coalesce(r.level, -1)), 0)::DOUBLE FROM sources)
    FROM rounds r WHERE n < 40),
targets AS (
    SELECT *, least(3.0 * source_size, coalesce(weight * (SELECT level FROM rounds ORDER BY n DESC LIMIT 1),
                                                3.0 * source_size))::DOUBLE AS target FROM sources),
keyed AS (
    SELECT d.*, t.source_size, t.target, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 15))::BIGINT AS key
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
sums AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM keyed)
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
       (size * epochs + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM sums"""


@query("op5_source_mixing", SQL)
def op5(spark, sf_dir):
    return mix(sized(table(spark, sf_dir, "documents")))

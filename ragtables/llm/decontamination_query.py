"""Query of the decontamination operator and its SQL: equal words counted on every alignment, without seeds."""

from ragtables.llm.catalog import query, table
from ragtables.llm.decontamination import contaminated

SQL = r"""
WITH dw AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
iw AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
d AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM dw),
i AS (SELECT item_id, least(len(w), 25) AS width, unnest(w) AS word, unnest(range(len(w))) AS pos FROM iw),
lines AS (
    SELECT doc_id, item_id, width, d.pos - i.pos AS shift, i.pos AS pos FROM d JOIN i USING (word)),
counted AS (
    SELECT doc_id, item_id, width, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos
           RANGE BETWEEN 24 PRECEDING AND CURRENT ROW) AS matched FROM lines)
SELECT doc_id, item_id, max(matched)::INT AS matched FROM counted
WHERE matched >= ceil(width * 0.8) GROUP BY doc_id, item_id"""


@query("op3_benchmark_decontamination", SQL)
def op3(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

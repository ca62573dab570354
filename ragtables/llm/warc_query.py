"""Query of the archive and its SQL; SHA-1 in base32 comes from 20 bits of the hexadecimal form at a time."""

from ragtables.llm.catalog import query, table
from ragtables.llm.warc import archive

SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
    SELECT page_id, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
           list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
               ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)),
               lambda a, b: a || b) AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""


@query("op10_warc_archive", SQL)
def op10(spark, sf_dir):
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

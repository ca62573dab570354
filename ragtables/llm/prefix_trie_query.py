"""Query of the prefix trie and its SQL: every prefix of every rebuilt conversation, and sums over all pairs of a node and a node above it."""

from ragtables.llm.catalog import query, table
from ragtables.llm.prefix_trie import prefix_trie

SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
           len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS words
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list({'key': key, 'words': words} ORDER BY turn NULLS FIRST, key) AS t FROM turns GROUP BY conv_id),
crc AS (
    SELECT conv_id, t, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS c FROM own),
rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.t[1:xor(a.c, 4294967295) % 4], []), a.t[xor(a.c, 4294967295) % 4 + 1:]) AS t
    FROM crc a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
paths AS (
    SELECT conv_id, coalesce(array_to_string(list_transform(t, lambda x: x.key), ''), '') AS path, t, len(t)::BIGINT AS n FROM rebuilt),
prefixes AS (
    SELECT conv_id, n, t, unnest(range(0, n + 1)) AS depth, path FROM paths),
nodes AS (
    SELECT path[1:64 * depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           any_value(CASE WHEN depth = 0 THEN 0 ELSE t[depth].words END) AS words,
           sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM prefixes GROUP BY 1, 2),
kids AS (SELECT node[1:64 * (depth - 1)] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (
    SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.node = n.node),
above AS (SELECT node, depth, n_convs, words, n_children, unnest(range(0, depth + 1)) AS up FROM counted),
sums AS (
    SELECT node[1:64 * up] AS node, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
    FROM above GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON s.node = n.node LEFT JOIN counted p ON n.depth > 0 AND p.node = n.node[1:64 * (n.depth - 1)]"""


@query("op13_prefix_trie", SQL)
def op13(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))

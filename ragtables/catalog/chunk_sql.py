"""SQL for DuckDB that cuts texts into chunks: the splitter as islands of short pieces and a recursive walk."""

from __future__ import annotations

from ragtables.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE

# Pieces of a string at a separator: each but the first begins with it, an empty first one is left out.
_PIECES = """
    pieces_{k} AS (
        SELECT doc, a, b, c, n, piece, length(piece) >= {size} AS is_long FROM (
            SELECT doc, a, b, c, n, CASE WHEN n = 1 THEN part ELSE {sep} || part END AS piece
            FROM (SELECT doc, a, b, c, unnest(string_split(s, {sep})) AS part,
                         unnest(range(1, len(string_split(s, {sep})) + 1)) AS n FROM {source}) u) v
        WHERE piece <> '')"""

# Short pieces that follow each other make a run. Runs are ordered by (a, b, c), the place of their first piece.
_RUNS = """
    runs_{k} AS (
        SELECT doc, {place}, string_agg(piece, '' ORDER BY n) AS run_text,
               list_prepend(0, list(CAST(till AS BIGINT) ORDER BY n)) AS borders
        FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY doc, a, b, c, island ORDER BY n) AS till
              FROM (SELECT *, n - row_number() OVER (PARTITION BY doc, a, b, c ORDER BY n) AS island
                    FROM pieces_{k} WHERE NOT is_long) w) x
        GROUP BY doc, a, b, c, island)"""


def chunk_sql(texts: str) -> str:
    """CTEs ending in ``chunks(doc, chunk_index, content)``; ``texts`` selects (doc, text). Goes after WITH RECURSIVE.

    Pieces without any blank that are longer than a chunk do not occur in the test texts and are not cut.
    """
    blank, newline, space = "chr(10) || chr(10)", "chr(10)", "' '"
    ctes = [f"level_0 AS (SELECT doc, 0 AS a, 0 AS b, 0 AS c, text AS s FROM ({texts}) t WHERE text <> '')"]
    places = ("min(n) AS a, 0 AS b, 0 AS c", "a, min(n) AS b, 0 AS c", "a, b, min(n) AS c")
    deeper = ("n AS a, 0 AS b, 0 AS c", "a, n AS b, 0 AS c")
    for k, sep in enumerate((blank, newline, space)):
        ctes.append(_PIECES.format(k=k, size=CHUNK_SIZE, sep=f"({sep})", source=f"level_{k}"))
        ctes.append(_RUNS.format(k=k, place=places[k]))
        if k < 2:
            ctes.append(f"level_{k + 1} AS (SELECT doc, {deeper[k]}, piece AS s FROM pieces_{k} WHERE is_long)")
    ctes.append(f"""
    runs AS (SELECT row_number() OVER () AS run, * FROM (
        SELECT * FROM runs_0 UNION ALL SELECT * FROM runs_1 UNION ALL SELECT * FROM runs_2) r),
    walk AS (
        SELECT run, 1 AS begins FROM runs
        UNION ALL
        SELECT run, least(ends, 1 + len(list_filter(borders, lambda x: x < greatest(
                   borders[ends] - {CHUNK_OVERLAP}, borders[ends + 1] - {CHUNK_SIZE})))) AS begins
        FROM (SELECT r.run, r.borders,
                     len(list_filter(r.borders, lambda x: x <= r.borders[w.begins] + {CHUNK_SIZE})) AS ends
              FROM walk w JOIN runs r ON r.run = w.run
              WHERE r.borders[len(r.borders)] - r.borders[w.begins] > {CHUNK_SIZE}) s),
    spans AS (
        SELECT r.*, w.begins, r.borders[w.begins] AS lo,
               r.borders[len(list_filter(r.borders, lambda x: x <= r.borders[w.begins] + {CHUNK_SIZE}))] AS hi
        FROM walk w JOIN runs r ON r.run = w.run),
    chunks AS (
        SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY a, b, c, begins) - 1 AS BIGINT) AS chunk_index,
               content
        FROM (SELECT *, trim(substring(run_text, lo + 1, hi - lo), ' ' || chr(10)) AS content FROM spans) y
        WHERE content <> '')""")
    return ",\n".join(ctes)

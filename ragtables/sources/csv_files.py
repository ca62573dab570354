"""CSV files as text parts: every file with its own header, one file over many tasks, quoted values with line ends.

A line end belongs to a quoted value if an odd number of quotes comes before it in the file. So each split counts its
quotes, sums over the splits before it tell whether a split starts inside a quoted value, and every task then knows which
of its lines begin a record. Only pieces of records that cross the border of a split are moved to meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragtables.functions.text import strip
from ragtables.operators.bounded import broadcast_if_small
from ragtables.session import materialize

#: Characters of the value of a field with the comma before it: quoted, or up to the next comma.
#: Possessive, so that long values are read in a loop and not by recursion.
FIELD = r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'
_PIECES = "path string, split long, place long, begins boolean, ends boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, split, value): lines of the files; rows of a split are in one task, in order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and pieces of them at the borders of a split, from lines (path, split, value, inside).

    ``begins`` and ``ends`` say whether the piece holds the start and the end of its record; ``place`` orders them in the split.
    """
    here, odd, open_lines, begun, place = None, 0, [], False, 0

    def piece(key, begins, ends, lines):
        return (*key, place, begins, ends, "\n".join(lines))

    for batch in batches:
        out = []
        paths, splits, starts = (batch.column(c).to_pylist() for c in ("path", "split", "inside"))
        values = pc.fill_null(batch.column("value"), "")
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2
        for path, split, start, line, more in zip(paths, splits, starts, values.to_pylist(), quotes.tolist(), strict=True):
            if (path, split) != here:
                if open_lines:
                    out.append(piece(here, begun, False, open_lines))
                here, odd, open_lines, begun, place = (path, split), int(start), [], not start, 0
            open_lines.append(line)
            odd ^= more
            if not odd:
                out.append(piece(here, begun, True, open_lines))
                open_lines, begun, place = [], True, place + 1
        if out:
            yield _table(out)
    if open_lines:
        yield _table([piece(here, begun, False, open_lines)])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])


def _inside(lines: DataFrame) -> DataFrame:
    """(path, split, inside): whether a split begins within a quoted value, from sums of quotes over the splits before it."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    sums = lines.groupBy("path", "split").agg(F.sum(quotes).alias("q"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("path", "split", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, part_no, record) of every record that is not empty, the header among them; part_no orders them in their file.

    A record lies with the split in which it begins. A quoted value that runs over whole splits is put together from their
    pieces, of which there are two for each split at most.
    """
    lines = _lines(spark, path)
    inside = broadcast_if_small(_inside(lines))
    known = lines.join(inside, ["path", "split"]).select("path", "split", "value", "inside")
    pieces = materialize(known.mapInArrow(_pieces, _PIECES), "pieces")
    whole = pieces.filter("begins and ends").select("path", "split", "place", F.col("text").alias("record"))
    torn = pieces.filter("not (begins and ends)")
    order = Window.partitionBy("path").orderBy("split", "place")
    owner = F.last(F.when(F.col("begins"), F.struct("split", "place")), ignorenulls=True).over(order)
    parts = torn.withColumn("owner", owner).groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("split", "place", "text"))).alias("p"))
    joined = parts.select("path", "owner.split", "owner.place", F.array_join(F.col("p.text"), "\n").alias("record"))
    return whole.unionByName(joined).filter("record <> ''").select("path", F.struct("split", "place").alias("part_no"), "record")


def fields(record):
    """Values of a record: quotes around a value go, doubled ones within become one."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(1))
    return F.transform(found, lambda v: F.when(v.startswith('"'), F.replace(F.regexp_replace(v, r'^"([^"]*+(?:""[^"]*+)*+)"', "$1"), F.lit('""'), F.lit('"')))
                       .otherwise(v))


def read_csv_parts(spark: SparkSession, path: str) -> DataFrame:
    """(path, part_no, text): one part per record, one line 'column: value' per column of the file's own header.

    Names and values lose white space at both ends; values that are missing at the end of a record are empty, those beyond
    the header are left out, and so are empty lines. A line end within a quoted value becomes a line feed. A quote in a
    value that is not quoted counts as one, so it must come in pairs. A file with a header alone gives no part.
    """
    records = materialize(csv_records(spark, path).withColumn("v", fields(F.col("record"))).drop("record"), "records")
    first = records.groupBy("path").agg(F.min("part_no").alias("first"))
    headers = records.join(first, "path").filter(F.col("part_no") == F.col("first"))
    headers = broadcast_if_small(headers.select("path", "first", F.transform("v", strip).alias("names")))
    rows = records.join(headers, "path").filter(F.col("part_no") > F.col("first"))
    line = F.transform("names", lambda n, i: F.concat(n, F.lit(": "), F.coalesce(strip(F.get("v", i)), F.lit(""))))
    return rows.select("path", "part_no", F.array_join(line, "\n").alias("text"))

"""Guards for broadcasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtables.session import materialize

MAX_BROADCAST_BYTES = 64 << 20
#: What a row and a column take in memory besides the characters of texts.
ROW_BYTES, COLUMN_BYTES, ELEMENT_BYTES = 32, 8, 64


def row_bytes(df: DataFrame):
    """Size of a row of narrow columns in memory, as a column: texts by their bytes, arrays by their elements."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, T.StringType)
             else F.coalesce(F.size(f.name), F.lit(0)) * ELEMENT_BYTES for f in df.schema if isinstance(f.dataType, (T.StringType, T.ArrayType))]
    return reduce(lambda a, b: a + b, sizes, F.lit(ROW_BYTES + COLUMN_BYTES * len(df.columns)))


def broadcast_if_small(keys: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a table of narrow keys if its measured bytes are few; else Spark shuffles both sides.

    The keys are written once, so nothing is computed twice.
    """
    written = materialize(keys, "keys")
    size = written.select(F.sum(row_bytes(written)).alias("b")).first()["b"] or 0
    return F.broadcast(written) if size <= max_bytes else written

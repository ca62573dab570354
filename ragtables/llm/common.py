"""Helpers of the operators: checked broadcasts, counts of tasks, texts as Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.session import materialize

MAX_BROADCAST_BYTES = 32 << 20
SLICE_BYTES = 4 << 20
#: What separates words: space and the control characters from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def broadcast_checked(df: DataFrame, name: str, row_bytes: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Write a table of narrow rows and hint a broadcast if its measured size is within the bound.

    Beyond the bound Spark shuffles both sides. ``row_bytes`` is the largest size of a row in memory.
    """
    written = materialize(df, name)
    return F.broadcast(written) if written.count() * row_bytes <= max_bytes else written


def lower_ascii(column):
    """A-Z in lower case, everything else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(column):
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(column, F.lit("")), BLANKS), "")


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of bounded text size (a longer text is a run of its own); null texts become empty.

    After the last run the memory of earlier batches goes back to the system, as workers stay for later stages.
    """
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    at = batch.schema.get_field_index(column)
    batch = batch.set_column(at, column, texts)
    offsets = _offsets(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield batch.slice(first, last - first)
        first = last
    pa.default_memory_pool().release_unused()


def _offsets(texts: pa.Array) -> np.ndarray:
    if len(texts) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each, beginning at 0."""
    offsets = _offsets(texts)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]

"""Fill-in-the-middle texts from piece tables.

A document is a list of pieces, each a run of bytes in a buffer that never changes: the texts of a batch, or the three
sentinels. Cutting splits a piece in two, an arrangement permutes pieces and puts sentinels between them, the inverse
permutation restores the text, and hashes read the pieces one after the other. No text is copied before it is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm.common import text_bytes, text_slices
from ragtables.llm.words import SPACE

SEED = "42"
#: Percent of texts that are rearranged, and percent of these with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: What follows what in each form, every part behind its sentinel.
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PARTS = ("prefix", "middle", "suffix")


class Piece(NamedTuple):
    """A run of bytes of a buffer."""

    buffer: memoryview
    start: int
    length: int

    def bytes(self) -> memoryview:
        return self.buffer[self.start : self.start + self.length]


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and after the place ``at``, counted in bytes; the one across it is split."""
    for i, piece in enumerate(pieces):
        if at < piece.length:
            left = [Piece(piece.buffer, piece.start, at)] if at else []
            return pieces[:i] + left, [Piece(piece.buffer, piece.start + at, piece.length - at), *pieces[i + 1 :]]
        at -= piece.length
    return pieces, []


_MARKS = {part: Piece(memoryview(mark), 0, len(mark)) for part, mark in SENTINELS.items()}


def arranged(parts: dict[str, list[Piece]], form: str) -> list[Piece]:
    """The parts in the order of the form, each behind its sentinel."""
    return [piece for part in ORDERS[form] for piece in (_MARKS[part], *parts[part])]


def restored(output: Piece, form: str) -> list[Piece]:
    """Pieces of the text from an arranged one: the parts between the sentinels, put back in their order."""
    if form not in ORDERS:
        return [output]
    data, at, found = bytes(output.bytes()), 0, {}
    order = ORDERS[form]
    for part, following in zip(order, (*order[1:], None), strict=True):
        at += len(SENTINELS[part])
        end = data.index(SENTINELS[following], at) if following else len(data)
        found[part] = Piece(output.buffer, output.start + at, end - at)
        at = end
    return [found[part] for part in PARTS]


def digest(pieces: Iterable[Piece]) -> str:
    """Hexadecimal SHA-256 of the bytes of all pieces."""
    sha = hashlib.sha256()
    for piece in pieces:
        sha.update(piece.bytes())
    return sha.hexdigest()


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all tokens as places in ``data``, offsets of the tokens of each text).

    A token is a word with the blanks before it, or the blanks at the end of a text.
    """
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    blank = SPACE[data]
    ends = last[:-1]
    ends[:-1] |= ~blank[:-1] & blank[1:]
    places = np.flatnonzero(ends) + 1
    return places, np.searchsorted(places, offsets, "right")


def _chars(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def choices(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits from the hash of the seed and the id; a missing id counts as the text ''."""
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(key[i : i + 8], 16) for i in range(0, 32, 8)]


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _arrange(seed: str, rate: int, suffix_first: int):
    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                data, offsets = text_bytes(part.column("text"))
                buffer = memoryview(data)
                ends, at = token_ends(data, offsets)
                rows = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    begin, end = int(offsets[i]), int(offsets[i + 1])
                    n = int(at[i + 1] - at[i])
                    text = [Piece(buffer, begin, end - begin)]
                    h1, h2, h3, h4 = choices(doc_id, seed)
                    whole = bytes(text[0].bytes())
                    if not whole or h3 % 100 >= rate or any(mark in whole for mark in SENTINELS.values()):
                        rows.append((doc_id, n, "plain", None, None, whole.decode(), digest(text)))
                        continue
                    low, high = (begin if k == 0 else int(ends[at[i] + k - 1]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    prefix, rest = cut(text, low - begin)
                    middle, suffix = cut(rest, high - low)
                    form = "spm" if h4 % 100 < suffix_first else "psm"
                    pieces = arranged({"prefix": prefix, "middle": middle, "suffix": suffix}, form)
                    rows.append((doc_id, n, form, _chars(data[begin:low]), _chars(data[low:high]),
                                 b"".join([p.bytes() for p in pieces]).decode(), digest(pieces)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(_OUT))

    return arrange


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256) for every row of ``docs`` (doc_id, text).

    A text of n tokens (see :func:`token_ends`) is cut at two places, numbers of tokens taken from a hash of seed and id.
    ``rate`` percent of texts, by the same hash, are put in the order suffix, prefix, middle (``spm``, ``suffix_first``
    percent of them) or prefix, suffix, middle (``psm``); the others stay as they are (``plain``), and so do empty texts
    and those that hold a sentinel. prefix_chars and middle_chars count code points and are null for plain texts.

    Null texts are empty. Rows without id take the hash of an empty id. Repeated rows come out as often as they are in
    the input, an empty table gives no rows, other columns are ignored. One narrow stage without a shuffle; memory holds
    the texts of a slice of a batch, or one longer text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_arrange(seed, rate, suffix_first), _OUT)


def _restore(keep_text: bool, names: list[str]):
    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "output"):
                data, offsets = text_bytes(part.column("output"))
                buffer, texts, hashes = memoryview(data), [], []
                for i, form in enumerate(part.column("form").to_pylist()):
                    pieces = restored(Piece(buffer, int(offsets[i]), int(offsets[i + 1] - offsets[i])), form)
                    hashes.append(digest(pieces))
                    if keep_text:
                        texts.append(b"".join([p.bytes() for p in pieces]).decode())
                out = [part.column(c) for c in names] + [pa.array(hashes, pa.string())]
                out += [pa.array(texts, pa.string())] if keep_text else []
                yield pa.record_batch(out, names=[*names, "restored_sha256", *["restored"] * keep_text])

    return restore


def restore(filled: DataFrame, keep_text: bool = True) -> DataFrame:
    """Rows of ``filled`` (output, form, ...) with restored_sha256 and restored in place of output.

    The text is rebuilt from output and form alone. ``keep_text`` False gives the hash only. A null output is empty.
    """
    names = [c for c in filled.columns if c not in ("output", "restored", "restored_sha256")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in filled.schema if f.name in names],
                        "restored_sha256 string", *["restored string"] * keep_text])
    return filled.mapInArrow(_restore(keep_text, names), schema)

"""Token ids in binary files: ids of many documents in one array, document boundaries and ids in Elias-Fano code.

A file holds one block: magic, header, boundaries (end of each document), document ids less the smallest, ids as
little-endian unsigned integers of 2 bytes (4 for vocabularies over 65,536), and one line end from the writer. The header
has the place of the block in the whole corpus as range and number, and a checksum of everything after it.
"""

from __future__ import annotations

import hashlib
import json
import os
import string
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragtables.llm import elias_fano
from ragtables.llm.common import text_slices
from ragtables.session import materialize, scratch_path

MAGIC = b"EFTOK1"
_HEAD = "<6sBxIIIQIqI"
BLOCK_IDS = 2 << 20
#: Documents whose boundaries are read at once.
RUN_DOCS = 4096
CACHED_WORDS = 400_000
END_ID = 2


# Fixed values of byte-level vocabularies: the pattern that cuts text, and the characters that stand for bytes.
CUT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
PLAIN = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
MARKS = string.punctuation
#: Beyond this character the pattern is left to the library, whose Unicode tables may differ.
LAST_CUT = "\u024f"


class Pieces(dict):
    """Ids of the pieces of texts between blanks, encoded by the library when first met.

    A piece is "\\0" and a word at the start of a text, a line end and a word, or a word after a single blank.
    Others are a KeyError. A word of letters after a blank is one stem, and so are marks at the end of one; only other
    words are cut by the pattern.
    """

    def __init__(self, tokenizer, kind: str):
        self.tokenizer, self.model, self.kind = tokenizer, tokenizer.model, kind
        self.stems: dict[str, bytes] = {}
        rest = iter(range(0x100, 0x200))
        self.letters = {i: i if i in PLAIN else next(rest) for i in range(256)}
        self.blank = chr(self.letters[0x20])

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha() and (piece.isascii() or max(piece) <= LAST_CUT):
            ids = self[piece] = self._ids(" " + piece)
            return ids
        word = piece.removeprefix("\0").removeprefix("\n")
        if word.split() != [word]:
            raise KeyError(piece)
        stem = piece.rstrip(MARKS)
        if stem.isalpha() and (stem.isascii() or max(stem) <= LAST_CUT):
            ids = self[stem] + self._stem(piece[len(stem) :])
        else:
            text = piece[1:] if piece[0] == "\0" else piece if piece[0] == "\n" else " " + piece
            if max(text) > LAST_CUT:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
            else:
                ids = b"".join(map(self._stem, CUT.findall(text)))
        self[piece] = ids
        return ids

    def _stem(self, text: str) -> bytes:
        if text[0] == " " and text[1:].isalpha():
            return self[text[1:]]
        ids = self.stems.get(text)
        if ids is None:
            ids = self.stems[text] = self._ids(text)
        return ids

    def _ids(self, text: str) -> bytes:
        if text.isascii() and text.isprintable():
            letters = text.replace(" ", self.blank)
        else:
            letters = text.encode().decode("latin-1").translate(self.letters)
        return array("H" if self.kind == "<u2" else "I", [t.id for t in self.model.tokenize(letters)]).tobytes()


class WordEncoder:
    """Ids of whole texts by the tokenizers library, with the pieces between blanks encoded once per worker process.

    For byte-level vocabularies whose words begin with their single blank: a text is cut before each single blank
    between other characters, where its words are cut anyway. A text with any other run of blanks goes to the library
    as a whole. Strings of special tokens are ordinary text.
    """

    def __init__(self, tokenizer, kind: str):
        self.tokenizer, self.kind = tokenizer, kind
        self.tokenizer.encode_special_tokens = True
        self.pieces = Pieces(tokenizer, kind)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self.pieces) > CACHED_WORDS:
            self.pieces.clear()
            self.pieces.stems.clear()
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return self.pieces["\0" + first] + b"".join(map(self.pieces.__getitem__, rest))
        except KeyError:  # other runs of blanks
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


def _encoder(vocabulary: str) -> tuple[WordEncoder, str]:
    """The encoder of this worker process; it outlives tasks, so later tasks find the words of earlier ones."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in kept:
        tokenizer = tokenizers.Tokenizer.from_str(vocabulary)
        kind = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        pre = json.loads(vocabulary).get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level vocabulary without a prefix blank is needed")
        kept.clear()
        kept[key] = WordEncoder(tokenizer, kind), kind
    return kept[key]


def pack_block(place: tuple[int, int], doc_ids: list[int | None], parts: list[bytes], kind: str) -> bytes:
    """Bytes of a block; documents in order, those without id first."""
    ids = b"".join(parts)
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    size = np.dtype(kind).itemsize
    ends = np.cumsum([len(p) // size for p in parts], dtype=np.int64)
    body = elias_fano.encode(ends) + elias_fano.encode((known.astype(object) - base).astype(np.int64) if len(known) else known) + ids
    return struct.pack(_HEAD, MAGIC, size, *place, len(parts), len(ids) // size, nulls, base, zlib.crc32(body)) + body


class Block:
    """A block that was read; ``start(i)`` and ``ids(i)`` find one document without decoding the boundaries of all."""

    def __init__(self, data: bytes):
        magic, self.size, self.range, self.number, self.count, self.n_ids, self.nulls, self.base, crc = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends = elias_fano.EliasFano(data, struct.calcsize(_HEAD))
        self.known = elias_fano.EliasFano(data, self.ends.end)
        at = self.known.end
        end = at + self.n_ids * self.size
        if len(data) < end or zlib.crc32(memoryview(data)[struct.calcsize(_HEAD) : end]) != crc:
            raise ValueError("damaged token file")
        self.tokens = np.frombuffer(data, f"<u{self.size}", self.n_ids, at)

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def ids(self, i: int) -> np.ndarray:
        return self.tokens[self.start(i) : self.ends.select(i)]

    def doc_ids(self, first: int = 0, last: int | None = None) -> list[int | None]:
        """Ids of documents ``first`` to ``last - 1``, or to the end; those without id come first."""
        last = self.ends.count if last is None else last
        known = self.known.select_run(max(first - self.nulls, 0), max(last - self.nulls, 0)) + self.base
        return [None] * (last - first - len(known)) + known.tolist()


def _pack(vocabulary: str, end_id: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = _encoder(vocabulary)
        end = np.array([end_id], kind).tobytes()
        part, number, docs, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for rows in text_slices(batch):
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    docs.append(doc_id)
                    parts.append(encoder.encode(text) + end)
                    size += len(parts[-1])
                    if size >= BLOCK_IDS * len(end):
                        yield pa.record_batch({"block": pa.array([pack_block((part, number), docs, parts, kind)], pa.binary())})
                        number, docs, parts, size = number + 1, [], [], 0
        if docs:
            yield pa.record_batch({"block": pa.array([pack_block((part, number), docs, parts, kind)], pa.binary())})

    return pack


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending doc_id order as files under ``path``.

    ``vocabulary`` is the JSON text of a tokenizer. Documents are range-partitioned by id, so every task writes a run of
    the order, in blocks of about ``BLOCK_IDS`` ids, one file each. Null texts are empty; rows without id come first;
    equal ids are ordered by a hash of the text. Every row is written, repeated ones too; other columns are ignored.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = ordered.mapInArrow(_pack(vocabulary, end_id), "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


_READ = "range long, number long, place long, doc_id long, start long, n_tokens long, ids_crc32 long, ids_in_block long"


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents of each block, in runs: the boundaries of a run come from select, its ids by slices between them."""
    for batch in batches:
        for content in batch.column("content"):
            block = Block(content.as_py())
            for first in range(0, block.ends.count, RUN_DOCS):
                last = min(first + RUN_DOCS, block.ends.count)
                ends = block.ends.select_run(first, last)
                starts = np.concatenate(([block.start(first)], ends[:-1])).astype(np.int64)
                wide = memoryview(block.tokens[starts[0] : ends[-1]].astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist(), strict=True)]
                n = last - first
                yield pa.record_batch([pa.array(np.full(n, block.range)), pa.array(np.full(n, block.number)), pa.array(np.arange(first, last)),
                                       pa.array(block.doc_ids(first, last), pa.int64()), pa.array(starts), pa.array(ends - starts),
                                       pa.array(crc, pa.int64()), pa.array(np.full(n, block.n_ids))],
                                      names=[c.split()[0] for c in _READ.split(", ")])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ...) of every document in files of :func:`write_token_files`.

    ``start`` counts the ids of all documents before, from running sums over the blocks of a range and over ranges.
    A damaged file is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(_unpack, _READ), "tokens")
    blocks = rows.filter("place = 0").select("range", "number", "ids_in_block")
    earlier = Window.partitionBy("range").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("in_range", F.coalesce(F.sum("ids_in_block").over(earlier), F.lit(0)))
    ranges = blocks.groupBy("range").agg(F.sum("ids_in_block").alias("ids"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    at = blocks.join(ranges, "range").select("range", "number", (F.col("in_range") + F.col("before")).alias("offset"))
    return rows.join(at, ["range", "number"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "range", "number", "place")


def token_files(docs: DataFrame, vocabulary_path: str, path: str | None = None) -> DataFrame:
    """Write the documents and read them back; an empty table writes no file and gives no rows."""
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    path = path or scratch_path(spark, "token-files")
    write_token_files(docs, vocabulary, path)
    return read_token_files(spark, path)

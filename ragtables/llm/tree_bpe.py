"""Encoding and decoding by a word BPE vocabulary, with tree concatenation of long text that nothing splits.

Blanks separate words in these vocabularies, so a text is cut at blanks without any doubt. Where a single word is long,
its halves are encoded apart, in parallel, and put together: a window around the join is encoded anew and grows until
its first token is the one the left half has there and its last token the one the right half has. A sequence of tokens
is the encoding of its text exactly if every two neighbours are the encoding of theirs. That holds within the halves and
within the window, and the tokens at its borders belong to both, so it holds for the whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm.common import text_slices
from ragtables.session import materialize

#: Characters of texts that one task encodes whole; longer ones are cut into pieces of at most so many.
LONG, PIECE = 32_768, 16_384
CACHED_WORDS, CACHED_LENGTH = 400_000, 64
#: Ids that are decoded at once.
DECODED_IDS = 1 << 20
_BLANKS, _RUNS = re.compile("[\x20\x09-\x0d]+"), re.compile("[^\x20\x09-\x0d]+")

# Fixed value: the pattern by which vocabularies of this kind cut lower-case text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Up to this character the pattern is put into plain classes; other text goes to the library, whose Unicode tables rule.
LAST_PLAIN = 0x24F
_ODD = re.compile(f"[\x00-\x08\x0e-\x1f\x7f-\xa0\u0130]|[^\x00-{chr(LAST_PLAIN)}]")


def _plain_words() -> re.Pattern:
    """The pattern for characters up to ``LAST_PLAIN``."""
    kinds = {kind: "".join(re.escape(chr(i)) for i in range(LAST_PLAIN + 1) if unicodedata.category(chr(i))[0] == kind) for kind in "LN"}
    return re.compile("[{L}]+|[{N}]|'(?:s|t|re|ve|m|ll|d)|[^\\x20\\x09-\\x0d{L}{N}]+".format(**kinds))


class Encoder:
    """A vocabulary with byte letters, a mark at word ends and blanks that only separate."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        config = json.loads(vocabulary)
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = config["model"].get("end_of_word_suffix")
        dropped = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        letters = steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex", True)
        norms = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers") or []]
        added = config.get("added_tokens") or []
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
        blanks = any(_BLANKS.search(t["content"]) for t in added)
        if not (suffix and dropped and letters and len(steps) == 2 and norms == ["NFC", "Replace", "Lowercase"] and plain and not blanks
                and steps[0]["pattern"].get("Regex") == PATTERN):
            raise ValueError("a vocabulary of lower-case words between blanks, in byte letters with a mark at word ends, is needed")
        config["truncation"] = config["padding"] = None
        self.library = Tokenizer.from_str(json.dumps(config))
        self.closed = self.library.model
        config["model"]["end_of_word_suffix"] = None
        self.open = Tokenizer.from_str(json.dumps(config)).model
        self.cut = _plain_words()
        self.special = {t["content"]: t["id"] for t in added}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.starts = tuple({name[:2] for name in self.special})
        size = max([*config["model"]["vocab"].values(), *self.special.values()], default=0) + 1
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.names = np.full(size, None, object)
        for name, number in (*config["model"]["vocab"].items(), *self.special.items()):
            self.names[number] = name
        self.lengths = np.array([len(n or "") for n in self.names], np.int64)
        rest = iter(range(0x100, 0x200))
        direct = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.letters = {i: i if i in direct else next(rest) for i in range(256)}
        self.known = Known(self)

    def is_plain(self, text: str) -> bool:
        """Whether lower-casing by Python and plain classes cut the text as the library does."""
        return not _ODD.search(text) and not any(s in text for s in self.starts)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian bytes."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if self.is_plain(text):
            return b"".join(map(self.known.__getitem__, self.cut.findall(text.lower())))
        return b"".join(map(self._run, _BLANKS.split(text)))

    def _run(self, run: str) -> bytes:
        """Ids of text without blanks."""
        if self.is_plain(run):
            return b"".join(map(self.known.__getitem__, self.cut.findall(run.lower())))
        return b"".join(self.word(w) if isinstance(w, str) else np.array([w], self.kind).tobytes() for w in self.words(run))

    def words(self, run: str) -> Iterator[str | int]:
        """The words of any text in byte letters, as the library cuts it, and ids of special tokens between them."""
        at = 0
        for found in (*self.specials.finditer(run), None):
            part = run[at : found.start()] if found else run[at:]
            if part:
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                yield from (w for w, _ in cut)
            if found:
                yield self.special[found.group()]
                at = found.end()

    def word(self, letters: str) -> bytes:
        """Ids of a word in byte letters."""
        if len(letters) <= PIECE:
            return array("H" if self.kind == "<u2" else "I", [t.id for t in self.closed.tokenize(letters)]).tobytes()
        leaves = halves(letters, PIECE)
        return self.tree([(x, self.leaf(x, i == len(leaves) - 1)) for i, x in enumerate(leaves)]).tobytes()

    def leaf(self, letters: str, last: bool) -> np.ndarray:
        """Ids of a part of a word; only at its last part stands the mark of the end."""
        return np.array([t.id for t in (self.closed if last else self.open).tokenize(letters)], self.kind)

    def tree(self, leaves: list[tuple[str, np.ndarray]], last: bool = True) -> np.ndarray:
        """Ids of a word from those of its leaves, put together by halves."""
        if len(leaves) == 1:
            return leaves[0][1]
        middle = len(leaves) // 2
        left, right = self.tree(leaves[:middle], False), self.tree(leaves[middle:], last)
        return self.join("".join(x for x, _ in leaves[:middle]), left, "".join(x for x, _ in leaves[middle:]), right, last)

    def join(self, text: str, left: np.ndarray, more: str, right: np.ndarray, last: bool) -> np.ndarray:
        """Ids of ``text + more`` from those of both: a window around the join grows until both sides agree with it."""
        a, b = 1, 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            whole_left, whole_right = a == len(left), b == len(right)
            before = len(text) if whole_left else int(self.lengths[left[-a:]].sum())
            after = len(more) if whole_right else int(self.lengths[right[:b]].sum())
            window = self.leaf(text[len(text) - before :] + more[:after], last and whole_right)
            agrees = whole_left or window[0] == left[-a], whole_right or window[-1] == right[b - 1]
            if all(agrees):
                return np.concatenate((left[: len(left) - a], window, right[b:]))
            a, b = a if agrees[0] else 2 * a, b if agrees[1] else 2 * b

    def decode(self, ids: np.ndarray) -> str:
        """Tokens by name between blanks, special ones too; ids outside the vocabulary are left out, as the library does."""
        ids = ids[(ids >= 0) & (ids < len(self.names))]
        return " ".join([n for n in self.names[ids].tolist() if n is not None])


class Known(dict):
    """Ids of lower-case words, encoded when first met."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.word(word if word.isascii() else word.encode().decode("latin-1").translate(self.encoder.letters))
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids


def halves(text: str, most: int) -> list[str]:
    """The text cut into halves, and these again, until none is longer than ``most``."""
    if len(text) <= most:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], most) + halves(text[middle:], most)


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """The encoder of this worker process; it outlives tasks, so later tasks find the words of earlier ones."""
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


_ENCODED = "doc_id long, ids array<int>"


def _batch(doc_ids: list, parts: list[bytes], kind: str) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(parts), kind).astype(np.int32)
    ends = np.cumsum([0, *[len(p) // np.dtype(kind).itemsize for p in parts]], dtype=np.int64)
    return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])


def _whole(vocabulary: str) -> Callable:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            for part in text_slices(batch):
                yield _batch(part.column("doc_id").to_pylist(), [encoder.encode(t) for t in part.column("text").to_pylist()], encoder.kind)

    return whole


_CUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("word", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
_CUT_COLUMNS = "row long, doc_id long, part long, word long, last boolean, text string"
#: Kinds of pieces that are no leaf of a word: text, and words in byte letters between blanks.
TEXT, WORDS = -1, -2


def pieces(encoder: Encoder, text: str, most: int) -> Iterator[tuple[int, bool, str]]:
    """(kind or number of the word, whether its last leaf, piece) of a text in order, none longer than ``most``.

    Pieces of text end at blanks. A run of more than ``most`` characters without a blank is cut into words, and words of
    more than ``most`` letters into leaves.
    """
    begin, end, word = 0, 0, 0
    for run in _RUNS.finditer(text):
        long = run.end() - run.start() > most
        if end > begin and (long or run.end() - begin > most):
            yield TEXT, True, text[begin:end]
            begin = end
        if not long:
            begin, end = run.start() if begin == end else begin, run.end()
            continue
        kept, size = [], 0
        for w in (*encoder.words(run.group()), None):
            if kept and (not isinstance(w, str) or size + len(w) >= most):
                yield WORDS, True, " ".join(kept)
                kept, size = [], 0
            if isinstance(w, int):
                yield TEXT, True, str(encoder.names[w])
            elif w is not None and len(w) > most:
                leaves = halves(w, most)
                for i, leaf in enumerate(leaves):
                    yield word, i == len(leaves) - 1, leaf
                word += 1
            elif w is not None:
                kept.append(w)
                size += len(w) + 1
        begin = end = run.end()
    if end > begin:
        yield TEXT, True, text[begin:end]


def _pieces(vocabulary: str, most: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            for part in text_slices(batch):
                for row, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                    found = list(pieces(encoder, text, most)) or [(TEXT, True, "")]
                    rows = [(row, doc_id, i, *piece) for i, piece in enumerate(found)]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CUT, strict=True)], schema=_CUT)

    return cut


def _encode_pieces(vocabulary: str) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            for part in text_slices(batch):
                ids = []
                for word, last, text in zip(*(part.column(c).to_pylist() for c in ("word", "last", "text")), strict=True):
                    ids.append(encoder.encode(text) if word == TEXT else b"".join(map(encoder.word, text.split(" "))) if word == WORDS
                               else encoder.leaf(text, last).tobytes())
                # Joins look at the letters of leaves only.
                texts = [t if w >= 0 else "" for w, t in zip(part.column("word").to_pylist(), part.column("text").to_pylist(), strict=True)]
                yield pa.record_batch([*(part.column(c) for c in ("row", "doc_id", "part", "word")), pa.array(texts, pa.string()), pa.array(ids, pa.binary())],
                                      names=["row", "doc_id", "part", "word", "text", "ids"])

    return encode


def _put_together(vocabulary: str) -> Callable:
    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by row and part; memory holds one document's ids and the leaves of one word."""
        encoder = encoder_of(vocabulary)
        row, doc, parts, word, leaves = None, None, [], None, []
        for batch in batches:
            for r, d, w, text, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "word", "text", "ids")), strict=True):
                if leaves and (r, w) != (row, word):
                    parts.append(encoder.tree(leaves).tobytes())
                    leaves = []
                if r != row:
                    if row is not None:
                        yield _batch([doc], [b"".join(parts)], encoder.kind)
                    row, doc, parts = r, d, []
                word = w
                if w >= 0:
                    leaves.append((text, np.frombuffer(ids, encoder.kind)))
                else:
                    parts.append(ids)
        if leaves:
            parts.append(encoder.tree(leaves).tobytes())
        if row is not None:
            yield _batch([doc], [b"".join(parts)], encoder.kind)

    return put_together


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(docs: DataFrame, vocabulary: str, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text): the ids the library gives the whole text, no special ones added.

    ``vocabulary`` is the JSON text of a tokenizer. Texts of up to ``long`` characters are encoded in the scan's own
    stage. Longer ones are cut into pieces of at most ``piece`` characters, at blanks, or, in a word that is longer than
    that, into halves; all pieces are dealt over all tasks, and the ids of a text are put together by its row, leaves of a
    word by tree concatenation. Pieces are written to the shared folder first, so rows keep their numbers if a task runs again.

    Null and empty texts have no ids. Strings of special tokens in a text are these tokens, as in the library. Rows
    without id and repeated rows come out like all others; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    short = docs.filter(size <= long).mapInArrow(_whole(vocabulary), _ENCODED)
    cut = docs.filter(size > long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_pieces(vocabulary, piece), _CUT_COLUMNS)
    cut = materialize(cut, "pieces").repartition("row", "part")
    ids = cut.mapInArrow(_encode_pieces(vocabulary), "row long, doc_id long, part long, word long, text string, ids binary")
    whole = ids.repartition("row").sortWithinPartitions("row", "part").mapInArrow(_put_together(vocabulary), _ENCODED)
    return short.unionByName(whole)


def _decode(vocabulary: str, names: list[str]) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < len(batch):
                before = ends[first - 1] if first else 0
                last = max(int(np.searchsorted(ends, before + DECODED_IDS, "right")), first + 1)
                part = batch.slice(first, last - first)
                texts = [encoder.decode(np.array([], np.int64) if x.values is None else x.values.drop_null().to_numpy(zero_copy_only=False))
                         for x in part.column("ids")]
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "decoded"])
                first = last
            pa.default_memory_pool().release_unused()

    return decode


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows with ``decoded``: what the library makes of ``ids`` with special tokens kept. Null ids are an empty text."""
    names = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in names], "decoded string"])
    return encoded.mapInArrow(_decode(vocabulary, names), schema)

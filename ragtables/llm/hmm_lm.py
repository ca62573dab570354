"""Hidden Markov language model: Baum-Welch counts over all partitions, exact likelihood of whole texts.

The symbols are the most frequent words, the end of a text, one for words that training has not seen, and bands of rarer
words by the size of their count. Every rarer word has expected counts of its own, in a distributed table: a state draws
it from its band by these, drawn to its share of the band. So each known word has its own emissions, and probabilities of
texts over the known words, the unseen word and the end sum to one. In training a word of count c stands for one of
count c - 1, as if its own occurrence were left out; so words that occur once teach the states where unseen words stand.

What is known of all words is a table in buckets of their hashes, a row per bucket. Chunks of texts ask it and add to it in
packed rows, one per chunk and bucket: no row per word goes through a shuffle.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm import hmm
from ragtables.llm.common import text_bytes, text_slices
from ragtables.llm.words import mix, word_hashes
from ragtables.session import materialize, scratch_path

HEAD_WORDS, STATES, PASSES = 16_384, 8, 3
CHUNK_TOKENS = 1_000_000
#: The starting point is fitted on so many whole texts of the table, by a hash, in so many rounds; training uses all texts.
FIRST_TEXTS, FIRST_ROUNDS = 400, 12
BANDS = 48
#: A rare word's own counts weigh as much as this many occurrences of its band.
OWN_STRENGTH = 2.0
#: Words of a task whose expected counts are summed before they are sent.
TASK_WORDS = 1 << 18
#: Distinct words of a bucket, about; symbols of a block of the model's counts.
BUCKET_WORDS, BLOCK_SYMBOLS = 1 << 17, 1024


def held_out(doc_id) -> bool:
    """True for documents that training leaves out; a null id counts as the text ''."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


_CHUNKS = "chunk long, doc_id array<long>, n array<int>, train array<boolean>, key array<long>, places binary, words binary, trained binary"
#: Rows to a bucket: kind 0 what is known of its words, kind 1 what a chunk asks or adds. Buckets below 0 are blocks of symbols.
_PACKED = "bucket int, kind int, chunk long, words binary, counts binary, shares binary"


def _pack(values: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, compressed."""
    planes = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_shares(shares: np.ndarray) -> bytes:
    """(words, states) of shares from 0 to 1, in steps of 2**-15."""
    return _pack(np.minimum(np.rint(shares.T * 32768), 32768).astype("<u2"))


def _unpack_shares(data: bytes, words: int) -> np.ndarray:
    steps = _unpack(data, "<u2")
    return steps.reshape(-1 if words else 1, words).T.astype(np.float32) / 32768


def _by_bucket(words: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(bucket, where its words are) of sorted words; nothing of none."""
    if not len(words):
        return
    buckets, first = np.unique(words >> np.uint64(64 - bits), return_index=True)
    for bucket, a, b in zip(buckets.tolist(), first, [*first[1:], len(words)], strict=True):
        yield bucket, slice(a, b)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """(bucket, its rows) of rows sorted by bucket, one row in memory at a time."""
    rows = ({c: batch.column(c)[i].as_py() for c in batch.schema.names} for batch in batches for i in range(len(batch)))
    return itertools.groupby(rows, key=lambda r: r["bucket"])


def _to_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind")


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])


def _chunk(number: int, docs: list, lengths: list, hashes: list) -> pa.RecordBatch:
    all_hashes, n = np.concatenate(hashes), np.concatenate(lengths)
    words, places, counts = np.unique(all_hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = rank[places]
    train = np.array([not held_out(d) for d in docs], bool)
    keys = np.array([zlib.crc32(b"" if d is None else str(d).encode()) for d in docs], np.uint64) + mix(n.astype(np.uint64))
    np.add.at(keys, np.repeat(np.arange(len(docs)), n), mix(all_hashes))
    trained = np.bincount(places[np.repeat(train, n)], minlength=len(words))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.record_batch([
        pa.array([TaskContext.get().partitionId() << 32 | number]), one(docs, pa.int64()), one(n.astype(np.int32), pa.int32()),
        one(train, pa.bool_()), one(mix(keys).view(np.int64), pa.int64()), pa.array([_pack(places.astype("<u4"))], pa.binary()),
        pa.array([words[order].tobytes()], pa.binary()), pa.array([_pack(trained.astype("<u4"))], pa.binary())], names=[c.split()[0] for c in _CHUNKS.split(", ")])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, size, docs, lengths, hashes = 0, 0, [], [], []
    for batch in batches:
        for part in text_slices(batch):
            h, at = word_hashes(*text_bytes(part.column("text")))
            docs += part.column("doc_id").to_pylist()
            lengths.append(np.diff(at))
            hashes.append(h)
            size += len(h) + len(part)
            if size >= CHUNK_TOKENS:
                yield _chunk(number, docs, lengths, hashes)
                number, size, docs, lengths, hashes = number + 1, 0, [], [], []
    if docs:
        yield _chunk(number, docs, lengths, hashes)


class Alphabet:
    """Symbols: the head words by rank, then the end, the unseen word, and the bands."""

    def __init__(self, head: np.ndarray, ends: int, totals: dict[int, int], n: int, distinct: int):
        self.order = np.argsort(head)
        self.head = head[self.order]
        self.end, self.unseen, self.size = len(head), len(head) + 1, len(head) + 2 + BANDS
        self.ends, self.totals, self.n, self.distinct = ends, totals, n, distinct

    def symbols(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Symbol of each word by its hash and count."""
        band = np.where(counts > 0, self.unseen + 1 + np.log2(np.maximum(counts, 1) + 0.5).astype(np.int64), self.unseen)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
            band = np.where(self.head[at] == words, self.order[at], band)
        return band

    def within(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each word given its symbol."""
        totals = np.ones(self.size)
        for band, total in self.totals.items():
            totals[self.unseen + 1 + band] = total
        return np.where(symbols > self.unseen, np.log10(np.maximum(counts, 1) / totals[symbols]), 0.0)


def _count(head_words: int):
    def count(batches):
        """What training texts hold of the words of each bucket, and its most frequent words."""
        for bucket, rows in _groups(batches):
            words, values, pending = [], [], 0
            for row in rows:
                counts = _unpack(row["counts"], "<u4")
                seen = counts > 0
                words.append(np.frombuffer(row["words"], np.uint64)[seen])
                values.append(counts[seen, None].astype(np.float64))
                pending += len(words[-1])
                if pending > 8 * BUCKET_WORDS:
                    words, values = [[x] for x in _summed(words, values)]
                    pending = 0
            words, values = _summed(words, values)
            counts = values[:, 0].astype(np.int64)
            bands = np.bincount(_band(counts), weights=counts, minlength=BANDS).astype(np.int64)
            top = np.lexsort((words.view(np.int64), -counts))[:head_words]
            yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([len(words)], pa.int64()), pa.array([words.tobytes()], pa.binary()),
                                   pa.array([_pack(counts)], pa.binary()), pa.array([bands], pa.list_(pa.int64())),
                                   pa.array([words[top].view(np.int64)], pa.list_(pa.int64())), pa.array([counts[top]], pa.list_(pa.int64()))],
                                  names=[c.split()[0] for c in _COUNTS.split(", ")])

    return count


_COUNTS = "bucket int, distinct long, words binary, counts binary, bands array<long>, top_words array<long>, top_counts array<long>"


def _band(counts: np.ndarray) -> np.ndarray:
    return np.log2(counts + 0.5).astype(np.int64)


def _asked_counts(bits: int):
    def asked(batches):
        for batch in batches:
            for i in range(len(batch)):
                words = np.frombuffer(batch.column("words")[i].as_py(), np.uint64)
                order = np.argsort(words)
                words, trained = words[order], _unpack(batch.column("trained")[i].as_py(), "<u4")[order]
                yield _packed([(b, 1, batch.column("chunk")[i].as_py(), words[at].tobytes(), _pack(trained[at]), None) for b, at in _by_bucket(words, bits)])

    return asked


def _asked_shares(bits: int, least: int, most: int):
    def asked(batches):
        for row in _rows(batches):
            texts = Texts.of(row)
            at = texts.asked(least, most)
            words = texts.words[at]
            yield _packed([(b, 1, row["chunk"], words[where].tobytes(), None, None) for b, where in _by_bucket(words, bits)])

    return asked


def _answered(values: str):
    """What a bucket knows of the words that a chunk asks for, in the order asked: their counts or their shares."""
    def answered(batches):
        for bucket, rows in _groups(batches):
            known = np.zeros(0, np.uint64)
            for row in rows:
                words = np.frombuffer(row["words"], np.uint64)
                if not row["kind"]:
                    known = words
                    table = (_unpack(row["counts"], "<i8") if values == "counts" else
                             _unpack(row["shares"], "<u2").reshape(-1 if len(words) else 1, len(words)))
                    continue
                if len(known):
                    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    found = np.where(known[at] == words, table[..., at], 0).astype(table.dtype)
                else:
                    found = np.zeros(len(words), "<i8") if values == "counts" else np.zeros(0, "<u2")
                yield pa.record_batch([pa.array([row["chunk"]], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_pack(found)], pa.binary())],
                                      names=["chunk", "bucket", "data"])

    return answered


def _told(known: DataFrame, asks: DataFrame, values: str, name: str) -> DataFrame:
    """(chunk, ``name``): what the buckets of ``known`` say to the chunks that ask."""
    rows = known.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "words", "counts",
                        F.col("shares") if values == "shares" else F.lit(None).cast("binary").alias("shares"))
    told = _to_buckets(rows.unionByName(asks)).mapInArrow(_answered(values), "chunk long, bucket int, data binary")
    return told.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias(name))


@dataclass
class Texts:
    """A chunk: places of its words with the place ``len(words)`` after each text, start and length of each text."""

    words: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    own: tuple[np.ndarray, np.ndarray] | None

    @staticmethod
    def of(row: dict) -> Texts:
        words = np.frombuffer(row["words"], np.uint64)
        n = np.array(row["n"], np.int64)
        ends = np.cumsum(n)
        places = np.insert(_unpack(row["places"], "<u4").astype(np.int64), ends, len(words))
        counts = np.zeros(len(words), np.int64)
        if row["counts"]:
            counts[np.argsort(words)] = np.concatenate([_unpack(x["data"], "<i8") for x in row["counts"]])
        texts = Texts(words, counts, places, ends - n + np.arange(len(n)), n + 1, None)
        if row.get("own"):
            at = texts.asked(row["least"], row["most"])
            buckets = [_unpack(x["data"], "<u2") for x in row["own"]]
            states = sum(map(len, buckets)) // len(at)
            texts.own = at, np.concatenate([x.reshape(states, -1) for x in buckets], axis=1).T.astype(np.float32) / 32768
        return texts

    def asked(self, least: int, most: int) -> np.ndarray:
        """Places of the words that occur so often in training, by their hashes."""
        order = np.argsort(self.words)
        return order[(self.counts[order] >= least) & (self.counts[order] <= most)]

    def symbols(self, alphabet: Alphabet, training: bool) -> np.ndarray:
        """Symbols of the words, and the end."""
        seen = np.maximum(self.counts - 1, 0) if training else self.counts
        return np.append(alphabet.symbols(self.words.view(np.int64), seen), alphabet.end)

    def emissions(self, alphabet: Alphabet, model: hmm.Model, bands: Bands | None, training: bool) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, emissions of the words and the end): what the states make of a symbol, and of the word within its band."""
        symbols = self.symbols(alphabet, training)
        emissions = model.emissions[symbols]
        if bands is not None and self.own is not None:
            at, own = self.own
            band = symbols[at] - alphabet.unseen - 1
            inner = band >= 0
            at, own, band = at[inner], own[inner], band[inner]
            weight = OWN_STRENGTH / 2.0**band[:, None]
            states = (bands.train if training else bands.whole)[band]
            ratio = np.divide(own[:, : states.shape[1]], states, out=np.ones(states.shape, np.float32), where=states > 0, casting="same_kind")
            emissions[at] *= (ratio + weight) / (1 + weight)
        return symbols, emissions


@dataclass
class Bands:
    """(bands, K): how the occurrences of the words of a band are dealt over the states, whole and with one occurrence of each left out."""

    whole: np.ndarray
    train: np.ndarray


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    arrays = ("n", "train", "key")
    for batch in batches:
        for i in range(len(batch)):
            yield {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) if c in arrays else batch.column(c)[i].values if c == "doc_id" else
                   batch.column(c)[i].as_py() for c in batch.schema.names}


def _numbers(counts: hmm.Counts, likelihood: float, states: int) -> pa.RecordBatch:
    """Rows of blocks of numbers: the counts of the symbols, then of the start, the likelihood and the moves."""
    values = np.concatenate((counts.emissions, counts.start[None], np.full((1, states), likelihood), counts.moves))
    return _packed([(-1 - b, 1, None, None, None, _pack(values[b * BLOCK_SYMBOLS : (b + 1) * BLOCK_SYMBOLS])) for b in range(-(-len(values) // BLOCK_SYMBOLS))])


def _sums(words: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of expected counts of words: their sums, and how these are dealt over the states."""
    totals = values.sum(axis=1)
    shares = values / np.maximum(totals, 1e-30)[:, None]
    return _packed([(b, 1, None, words[at].tobytes(), _pack(totals[at].astype("<f4")), _pack_shares(shares[at])) for b, at in _by_bucket(words, bits)])


def _reduced(alphabet: Alphabet, states: int):
    def reduced(batches):
        """Per bucket the shares of the states in each word, and of each band sums of words weighed by count, whole and with one left out."""
        for bucket, rows in _groups(batches):
            if bucket < 0:
                total = sum(_unpack(row["shares"], "<f8") for row in rows)
                yield _known(bucket, None, None, _pack(total), None)
                continue
            words, counts, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, states))
            for row in rows:
                more = np.frombuffer(row["words"], np.uint64)
                if not row["kind"]:
                    words, counts, sums = more, _unpack(row["counts"], "<i8"), np.zeros((len(more), states))
                else:
                    sums[np.searchsorted(words, more)] += _unpack_shares(row["shares"], len(more)) * _unpack(row["counts"], "<f4")[:, None].astype(np.float64)
            shares = np.minimum(sums / np.maximum(counts, 1)[:, None], 1.0)
            rare = alphabet.symbols(words.view(np.int64), counts) > alphabet.unseen
            bands = np.zeros((2, BANDS, states + 1))
            for left_out in (0, 1):
                weighed = rare & (counts > left_out)
                weight = counts[weighed] - left_out
                for k in range(states + 1):
                    bands[left_out, :, k] = np.bincount(_band(weight), weights=weight * (shares[weighed, k] if k < states else 1.0), minlength=BANDS)
            yield _known(bucket, words.tobytes(), _pack(counts), _pack_shares(shares), bands.reshape(-1))

    return reduced


_KNOWN = "bucket int, words binary, counts binary, shares binary, bands array<double>"


def _known(bucket, words, counts, shares, bands) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
    return pa.record_batch([pa.array([x], t) for x, t in zip((bucket, words, counts, shares, bands), kinds, strict=True)],
                           names=[c.split()[0] for c in _KNOWN.split(", ")])


def _summed(items: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items and the sums of their rows."""
    distinct, at = np.unique(np.concatenate(items), return_inverse=True)
    rows = np.concatenate(values)
    return distinct, np.stack([np.bincount(at, weights=rows[:, k], minlength=len(distinct)) for k in range(rows.shape[1])], axis=1)


def _model_of(blocks: dict[int, np.ndarray], prior: np.ndarray, states: int) -> hmm.Model:
    """Model of the blocks of ``_numbers`` by bucket."""
    values = np.concatenate([blocks[b] for b in sorted(blocks, reverse=True)]).reshape(-1, states)
    size = len(prior)
    return hmm.estimate(hmm.Counts(values[size], values[size + 2 :], values[:size]), prior)


def _chosen(alphabet: Alphabet, places: dict[int, list[int]]):
    """(key, symbols) of the texts at these places of chunks."""
    def chosen(batches):
        for row in _rows(batches):
            texts = Texts.of(row)
            symbols = texts.symbols(alphabet, True)
            for i in places[row["chunk"]]:
                text = symbols[texts.places[texts.starts[i] : texts.starts[i] + texts.lengths[i]]]
                yield pa.record_batch([pa.array([row["key"][i]], pa.int64()), pa.array([text.astype("<i4").tobytes()], pa.binary())], names=["key", "symbols"])

    return chosen


def _first(prior: np.ndarray, states: int):
    def first(batches):
        texts = [np.frombuffer(x, "<i4").astype(np.int64) for batch in batches for x in batch.column("symbols").to_pylist()]
        if texts:
            lengths = np.array([len(x) for x in texts])
            symbols, starts = np.concatenate(texts), np.cumsum(lengths) - lengths
            model = hmm.first_model(symbols, starts, lengths, prior, states, FIRST_ROUNDS)
            counts, likelihood = hmm.expected_counts(model, symbols, starts, lengths)
            yield _numbers(counts, likelihood, states)

    return first


def _first_counts(known: DataFrame, chunks: DataFrame, alphabet: Alphabet, prior: np.ndarray, states: int) -> list:
    """Counts of the starting point, from the training texts with the least hash of id and words, in whichever chunk."""
    texts = chunks.select("chunk", F.posexplode(F.arrays_zip("key", "train")).alias("at", "t")).filter("t.train")
    places: dict[int, list[int]] = {}
    for r in texts.orderBy("t.key", "chunk", "at").limit(FIRST_TEXTS).select("chunk", "at").collect():
        places.setdefault(r["chunk"], []).append(r["at"])
    if not places:
        return []
    found = known.filter(F.col("chunk").isin(list(places))).mapInArrow(_chosen(alphabet, places), "key long, symbols binary")
    return found.repartition(1).sortWithinPartitions("key", "symbols").mapInArrow(_first(prior, states), _PACKED).collect()


def _expect(alphabet: Alphabet, model: hmm.Model, bands: Bands | None, least: int, bits: int):
    states = len(model.start)

    def expect(batches):
        sums, likelihood, items, values = None, 0.0, [], []
        for row in _rows(batches):
            texts, train = Texts.of(row), np.array(row["train"], bool)
            symbols, emissions = texts.emissions(alphabet, model, bands, True)
            counts, more = hmm.expected_counts(hmm.Model(model.start, model.moves, emissions), texts.places, texts.starts[train], texts.lengths[train])
            likelihood += more
            by_symbol = np.stack([np.bincount(symbols, weights=counts.emissions[:, k], minlength=alphabet.size) for k in range(states)], axis=1)
            if sums is None:
                sums = hmm.Counts(counts.start, counts.moves, by_symbol)
            else:
                sums.start += counts.start
                sums.moves += counts.moves
                sums.emissions += by_symbol
            rare = np.flatnonzero((symbols[:-1] >= alphabet.unseen) & (texts.counts >= least) & counts.emissions[:-1].any(axis=1))
            items.append(texts.words[rare])
            values.append(counts.emissions[rare])
            del texts, emissions, counts, by_symbol
            if sum(map(len, items)) > TASK_WORDS:
                items, values = [[x] for x in _summed(items, values)]
                if len(items[0]) > TASK_WORDS // 2:
                    yield _sums(items[0], values[0], bits)
                    items, values = [], []
        if items:
            yield _sums(*_summed(items, values), bits)
        if sums is not None:
            yield _numbers(sums, likelihood, states)

    return expect


def _passed(told: DataFrame, counts: DataFrame, step, alphabet: Alphabet, prior: np.ndarray, states: int) -> tuple[hmm.Model, DataFrame, Bands]:
    """Model, what is known of the words of each bucket, and the bands, after a pass over all training texts."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("chunk", "long"), ("shares", "binary"))]
    counted = counts.select("bucket", F.lit(0).alias("kind"), empty[0], "words", "counts", empty[1])
    sums = _to_buckets(counted.unionByName(told.mapInArrow(step, _PACKED)))
    sums = materialize(sums.mapInArrow(_reduced(alphabet, states), _KNOWN), "sums")
    model = _model_of({r["bucket"]: _unpack(r["shares"], "<f8") for r in sums.filter("bucket < 0").select("bucket", "shares").collect()}, prior, states)
    own = sums.filter("bucket >= 0")
    table = np.zeros(2 * BANDS * (states + 1))
    for at, total in own.select(F.posexplode("bands").alias("at", "x")).groupBy("at").agg(F.sum("x")).collect():
        table[at] = total
    table = table.reshape(2, BANDS, states + 1)
    return model, own, Bands(*(table[..., :states] / np.maximum(table[..., states:], 1e-30)))


def _with_own(known: DataFrame, own: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """Chunks with the shares of their own rare words that occur at least ``least`` times; no rare word occurs more than ``most`` times."""
    told = _told(own, known.mapInArrow(_asked_shares(bits, least, most), _PACKED), "shares", "own")
    return known.join(told, "chunk", "left").withColumns({"least": F.lit(least), "most": F.lit(most)})


def _by_chunk(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder in buckets of chunks and read it back, so that joins on the chunk move nothing."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, "chunk").option("path", scratch_path(spark, name)).saveAsTable(table)
    written = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    return written


@contextmanager
def _shuffles_dropped(spark):
    """Within, the files of a shuffle go when the query that made them has ended; its result is in the shared folder by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _score(alphabet: Alphabet, model: hmm.Model, bands: Bands | None):
    def score(batches):
        for row in _rows(batches):
            texts = Texts.of(row)
            lengths, counts = texts.lengths, np.append(texts.counts, alphabet.ends)
            docs = len(lengths)
            owner = np.repeat(np.arange(docs), lengths)
            base = np.log10((counts + 1) / (alphabet.n + alphabet.distinct + 1))
            known = np.bincount(owner, weights=(counts > 0)[texts.places], minlength=docs).astype(np.int64)
            plain = np.bincount(owner, weights=base[texts.places], minlength=docs)
            symbols, emissions = texts.emissions(alphabet, model, bands, False)
            inner = alphabet.within(symbols, counts)
            total = hmm.log_likelihood(hmm.Model(model.start, model.moves, emissions), texts.places, texts.starts, lengths) / np.log(10) + np.bincount(
                owner, weights=inner[texts.places], minlength=docs)
            yield pa.record_batch([row["doc_id"], pa.array(~np.array(row["train"], bool)), pa.array(lengths), pa.array(known),
                                   pa.array(np.full(docs, alphabet.n, np.int64)), pa.array(plain), pa.array(total)],
                                  names=[c.split()[0] for c in _SCORES.split(", ")])

    return score


def score_texts(docs: DataFrame, head_words: int = HEAD_WORDS, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text); see the module for the model.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are the words of the whole text
    (A-Z in lower case) and an end. Training learns from documents whose crc32 of the id as text, modulo 7, is not 2.
    Words are known by 64-bit hashes, so their length does not matter. The table of counts of all words is never
    broadcast: each chunk of texts asks the buckets for its own words. What is sent around has a fixed size (``head_words``
    plus bands, times ``states``); the expected counts of all other words stay in their buckets, and before each pass and the
    scoring each chunk asks for those of its own words, which come in steps of 2^-15. Baum-Welch takes ``passes`` passes over all training texts, each
    summing counts per task before the shuffle; the first one knows rare words by their bands only. The starting point
    comes from ``FIRST_TEXTS`` training texts with the least hash of id and words, so neither files nor splits change it.

    Null and empty texts are an end alone. Rows without id are learned from and scored. Repeated rows count each. Without
    training texts every word is unseen and the model is uniform. An empty table gives no rows.
    """
    with _shuffles_dropped(docs.sparkSession):
        return _scored(docs, head_words, states, passes)


def _bucket_bits(chunks: DataFrame) -> int:
    """Bits of the hash that make a word's bucket, from the number of distinct words, which a part of all hashes estimates."""
    def part(batches):
        for batch in batches:
            for data in batch.column("words").to_pylist():
                words = np.frombuffer(data, np.uint64)
                yield pa.record_batch([pa.array(words[words & np.uint64(1023) == 0].view(np.int64))], names=["word"])

    distinct = chunks.select("words").mapInArrow(part, "word long").distinct().count() * 1024
    return max(5, (distinct // BUCKET_WORDS).bit_length())


def _scored(docs: DataFrame, head_words: int, states: int, passes: int) -> DataFrame:
    chunks = _by_chunk(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunks, _CHUNKS), "chunks")
    train_docs = chunks.select(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0
    bits = _bucket_bits(chunks)
    asks = chunks.select("chunk", "words", "trained").mapInArrow(_asked_counts(bits), _PACKED)
    counts = materialize(_to_buckets(asks).mapInArrow(_count(head_words), _COUNTS), "counts")
    tops = counts.select(F.explode(F.arrays_zip("top_words", "top_counts")).alias("t")).select(F.col("t.top_words").alias("word"), F.col("t.top_counts").alias("count"))
    top = tops.orderBy(F.col("count").desc(), "word").limit(head_words).collect()
    head, rank = np.array([r["word"] for r in top], np.int64), np.array([r["count"] for r in top], np.int64)
    totals = np.zeros(BANDS, np.int64)
    for at, total in counts.select(F.posexplode("bands").alias("at", "x")).groupBy("at").agg(F.sum("x")).collect():
        totals[at] = total
    n, distinct = int(totals.sum()), counts.agg(F.sum("distinct")).first()[0] or 0
    np.subtract.at(totals, _band(rank), rank)
    totals = {b: int(total) for b, total in enumerate(totals) if total}
    alphabet = Alphabet(head, train_docs, totals, n + train_docs, distinct + (train_docs > 0))
    known = chunks.drop("trained").join(_by_chunk(_told(counts, asks, "counts", "counts"), "known"), "chunk", "left")

    # What is known of each symbol at the start: its share, with a little for all.
    share = np.zeros(alphabet.size)
    share[: len(head)] = rank
    share[alphabet.end] = train_docs
    for b, total in totals.items():
        share[alphabet.unseen + 1 + b] = total
    share[alphabet.unseen] = share[alphabet.unseen + 1]
    prior = (share + 0.01) / (share + 0.01).sum()

    model = hmm.estimate(hmm.Counts(np.zeros(states), np.zeros((states, states)), np.zeros((alphabet.size, states))), prior)
    first = _first_counts(known, chunks, alphabet, prior, states)
    bands, told = None, known
    if first:
        model = _model_of({r["bucket"]: _unpack(r["shares"], "<f8") for r in first}, prior, states)
        for left in reversed(range(passes)):
            # In training a word that occurs once stands for an unseen one, so only the scoring needs its own counts.
            least = 2 if left else 1
            model, own, bands = _passed(told, counts, _expect(alphabet, model, bands, least, bits), alphabet, prior, states)
            told = _with_own(known, own, least, int(rank[-1]) if len(rank) else 0, bits)
    return told.mapInArrow(_score(alphabet, model, bands), _SCORES)

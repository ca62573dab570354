"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm.common import text_bytes, text_slices
from ragtables.llm.words import mix, word_hashes
from ragtables.session import materialize

#: Share of the pooled covariance in each class, and of the scaled identity in the result.
POOLED, ROUND = 0.05, 0.02
NAMES = ("words", "word_length", "upper", "odd", "bars", "exclaims", "digits", "repeats", "distinct", "stops", "lines",
         "pair_repeats", "non_ascii", "largest_share")


def held_out(doc_id) -> bool:
    """True for documents whose labels are never learned; a null id counts as the text ''."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 1


def _class_counts(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.int32)  # a cell has less than 2^31 bytes
    np.cumsum(members[data], dtype=np.int32, out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _members(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text; an empty text has zeros but for constants."""
    hashes, at = word_hashes(data, offsets)
    words = np.diff(at).astype(float)
    n = np.maximum(words, 1.0)
    size = np.diff(offsets).astype(float)
    upper = _class_counts(data, offsets, _members(bytes(range(65, 91))))
    lower = _class_counts(data, offsets, _members(bytes(range(97, 123))))
    odd = _class_counts(data, offsets, _members(b"*$%&#@^~<>{}[]=+\\/_`"))
    lines = _class_counts(data, offsets, _members(b"\n"))
    bars = _class_counts(data, offsets, _members(b"|"))
    exclaims = _class_counts(data, offsets, _members(b"!"))
    digits = _class_counts(data, offsets, _members(bytes(range(48, 58))))
    stops = _class_counts(data, offsets, _members(b".,;:?"))
    blanks = _class_counts(data, offsets, _members(b" \t\n\x0b\x0c\r"))
    wide = _class_counts(data, offsets, np.arange(256) >= 0xC0)
    same = np.concatenate(([0], np.cumsum(hashes[1:] == hashes[:-1])))
    distinct, pairs, largest = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words))
    repeats = np.zeros(len(words))
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a < 2:
            distinct[i] = b - a
            continue
        repeats[i] = same[b - 1] - same[a]
        ordered = np.sort(hashes[a:b])
        places = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        distinct[i] = len(places)
        largest[i] = np.diff(np.append(places, b - a)).max()
        two = np.sort(mix(hashes[a : b - 1] + np.roll(hashes[a:b], -1)[:-1] * np.uint64(3)))
        pairs[i] = 1 + np.count_nonzero(two[1:] != two[:-1])
    several = np.maximum(words - 1, 1.0)
    root = np.sqrt
    columns = (np.log1p(words), np.log1p((size - blanks) / n), root(upper / np.maximum(upper + lower, 1)), root(odd / n),
               root(bars / n), root(exclaims / n), root(digits / n), root(repeats / several),
               np.log1p(distinct) - 0.85 * np.log1p(words), root(stops / n), root(lines / n),
               root(np.maximum(0, 1 - pairs / several)) * (words > 1), root(wide / np.maximum(size, 1)), root(largest / n))
    return np.stack(columns, axis=1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            x = statistics(*text_bytes(part.column("text")))
            yield pa.record_batch([part.column("doc_id"), *[pa.array(np.ascontiguousarray(c)) for c in x.T]],
                                  names=["doc_id", *[f"x_{name}" for name in NAMES]])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f"x_{name}").to_numpy(zero_copy_only=False) for name in NAMES], axis=1)


@dataclass
class Discriminant:
    """Per class the mean, the inverse of the Cholesky factor of its covariance, and the constant of its log density."""

    means: list[np.ndarray]
    whiteners: list[np.ndarray]
    constants: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        densities = []
        for mean, whitener, constant in zip(self.means, self.whiteners, self.constants, strict=True):
            z = (x - mean) @ whitener.T
            densities.append(constant - 0.5 * np.einsum("ij,ij->i", z, z))
        return densities[1] - densities[0]


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, rounded: float = ROUND) -> Discriminant | None:
    """Discriminant from count, sum and sum of products of each class; None unless both classes have rows."""
    if any(c not in sums or sums[c][0] < 1 for c in (0, 1)):
        return None
    total = sum(sums[c][0] for c in (0, 1))
    width = len(sums[0][1])
    means = [sums[c][1] / sums[c][0] for c in (0, 1)]
    own = [sums[c][2] / sums[c][0] - np.outer(means[c], means[c]) for c in (0, 1)]
    common = sum(sums[c][0] * own[c] for c in (0, 1)) / total
    # Statistics are compared in units of their pooled spread; one without spread has the unit 1.
    unit = np.sqrt(np.maximum(np.diag(common), 1e-12))
    unit[np.diag(common) < 1e-12] = 1.0
    whiteners, constants = [], []
    for c in (0, 1):
        few = width / (sums[c][0] + width)
        share = pooled + (1 - pooled) * few
        covariance = ((1 - share) * own[c] + share * common) / np.outer(unit, unit)
        covariance = (1 - rounded) * covariance + rounded * np.eye(width)
        factor = np.linalg.cholesky(covariance)
        whiteners.append(np.linalg.inv(factor) / unit)
        constants.append(float(np.log(sums[c][0] / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(means, whiteners, constants)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per class of a task, as (label, item, value)."""
    sums: dict[int, np.ndarray] = {}
    width = len(NAMES)
    for batch in batches:
        x, label = _matrix(batch), batch.column("label").to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[label == c]
            flat = np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)))
            sums[c] = sums.get(c, np.zeros(1 + width + width * width)) + flat
    for c, flat in sums.items():
        yield pa.record_batch([pa.array(np.full(len(flat), c)), pa.array(np.arange(len(flat))), pa.array(flat)],
                              names=["label", "item", "value"])


def train(features: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on all labelled documents that are not held out; sums per class are made in the tasks.

    Of several labels of a document the lowest counts; null labels and those other than 0 and 1 are left out.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    rows = features.join(known, "doc_id").select("label", *[f"x_{name}" for name in NAMES])
    rows = rows.mapInArrow(_partial, "label long, item long, value double").groupBy("label", "item").agg(F.sum("value").alias("value"))
    flat: dict[int, np.ndarray] = {}
    width = len(NAMES)
    for row in rows.collect():
        flat.setdefault(row["label"], np.zeros(1 + width + width * width))[row["item"]] = row["value"]
    return fit({c: (v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width)) for c, v in flat.items()})


def _score(model: Discriminant | None):
    def score(batches):
        for batch in batches:
            odds = model.log_odds(_matrix(batch)) / len(NAMES) if model else np.zeros(len(batch))
            chance = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.record_batch([batch.column("doc_id"), pa.array([held_out(d) for d in batch.column("doc_id").to_pylist()], pa.bool_()),
                                   pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text) by the labels (doc_id, quality).

    The score is a logistic function of the difference of the classes' log densities, prior included, per statistic.
    Only the text is used. Null texts are empty and scored like any other. Rows without id are scored. Without labels of
    both classes every score is 0.5. Repeated rows count each; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = ", ".join(["doc_id long", *[f"x_{name} double" for name in NAMES]])
    features = materialize(docs.mapInArrow(_statistics, schema), "statistics")
    return features.mapInArrow(_score(train(features, labels)), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns; a null text comes out empty.

    The statistics that train the model are made first; texts are then read once more and filtered where they lie.
    """
    features_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = ", ".join(["doc_id long", *[f"x_{name} double" for name in NAMES]])
    model = train(materialize(features_of.mapInArrow(_statistics, schema), "statistics"), labels)

    def keep(batches):
        for batch in batches:
            for part in text_slices(batch):
                odds = model.log_odds(statistics(*text_bytes(part.column("text")))) if model else np.zeros(len(part))
                yield pa.record_batch([part.column(c) for c in part.schema.names], schema=part.schema).filter(pa.array(odds >= 0))

    return docs.mapInArrow(keep, docs.schema)

"""Secrets in texts: patterns of known kinds, and windows of high Shannon entropy per class of characters."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm.common import text_slices

# The patterns of the known kinds and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy scan: runs of the characters of encoded secrets.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Class of characters: (pattern of the whole candidate, least bits per character in a window).
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+"), 3.0), ("digits_and_letters", re.compile(r"[A-Za-z0-9]+"), 3.6),
           ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7))
#: Candidates that are no secrets although they look random: identifiers, dates, counting sequences, fillers.
ALLOWED = (re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), re.compile(r"[0-9_/=+-]+"),
           re.compile(r"(?i)(0123456789|abcdefghij|qwertyuiop|example|placeholder|changeme|xxxxxx).*"),
           re.compile(r"[A-Za-z]+([_/-][A-Za-z]+)*"), re.compile(r"\d{4}-\d\d-\d\d.*"), re.compile(r"(?i)(utm_|https?|www).*"))
_PRE = r"(?i)(password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[a-z0-9+/_=-]{20}"


def entropy_windows(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of a string that have at least ``least`` bits per character.

    The sum of c * log2(c) over the counts of the characters is kept up to date as the window moves: one count goes up
    and one down at each step.
    """
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, character in enumerate(text):
        c = counts.get(character, 0)
        total += weigh[c + 1] - weigh[c]
        counts[character] = c + 1
        if i >= window:
            gone = text[i - window]
            c = counts[gone]
            total += weigh[c - 1] - weigh[c]
            counts[gone] = c - 1
        if i >= window - 1 and math.log2(window) - total / window >= least:
            begin = i - window + 1
            if spans and begin <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((begin, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the known kinds, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of high entropy; one that overlaps spans already found is cut at them, and what still holds a window remains."""
    found = []
    for m in CANDIDATE.finditer(text):
        candidate = m[0]
        if not (re.search(r"[0-9]", candidate) and re.search(r"[A-Za-z]", candidate)):
            continue
        if any(p.fullmatch(candidate) for p in ALLOWED):
            continue
        least = next(bits for _, pattern, bits in CLASSES if pattern.fullmatch(candidate))
        for begin, end in entropy_windows(candidate, WINDOW, least):
            begin, end = begin + m.start(), end + m.start()
            for left, right in _outside(begin, end, taken):
                if (left, right) == (begin, end) or entropy_windows(text[left:right], WINDOW, least):
                    found.append((left, 3, right))
    return found


def _outside(begin: int, end: int, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the sorted spans ``taken`` leave of a span."""
    for a, _, b in taken:
        if begin < end and a < end and begin < b:
            if begin < a:
                yield begin, a
            begin = b
    if begin < end:
        yield begin, end


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{begin}:{end}" for begin, kind, end in spans)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
_NOTHING = hashlib.sha256(b"").hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            texts = part.column("text")
            likely = pc.match_substring_regex(texts, _PRE).to_pylist()
            rows = []
            for i, maybe in enumerate(likely):
                if not maybe:
                    rows.append((0, 0, 0, _NOTHING, "", 0))
                    continue
                text = texts[i].as_py()
                base = base_spans(text)
                more = entropy_spans(text, base)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(sorted(base + more)), len(more)))
            names = [c.split()[0] for c in _SCHEMA.split(", ")]
            yield pa.record_batch([part.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names=names)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text): counts, a digest of the base spans, and all spans.

    Spans are in code points of the whole text, the end exclusive, of the whole match. The entropy scan adds spans that
    overlap no base span, cut at base spans where they run into one. Texts in which one linear pattern finds no trace of a kind are not searched further. Null and
    empty texts have no spans; rows without id are scanned; repeated rows come out as often; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _SCHEMA)

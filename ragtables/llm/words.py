"""Word hashes of many texts at once: array arithmetic over their UTF-8 bytes instead of a loop over words."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _cut(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """First place from ``at`` on where no word goes on: a blank or the start of a text."""
    end = int(offsets[np.searchsorted(offsets, at)])
    while at < end:
        blanks = np.flatnonzero(SPACE[data[at : min(at + 65536, end)]])
        if len(blanks):
            return at + int(blanks[0])
        at = min(at + 65536, end)
    return end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word with A-Z in lower case, offsets of the words of each text).

    Words are runs of bytes outside the blanks and never cross texts. The hash is a polynomial of the bytes modulo 2^64,
    from differences of running sums, then mixed.
    """
    hashes, starts = [], []
    total, low = int(offsets[-1]), 0
    while low < total:
        high = low + CHUNK
        high = total if high >= total else _cut(data, offsets, high)
        part = LOWER[data[low:high]]
        inside = ~SPACE[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        borders = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high)] - low
        begins[borders] = inside[borders]
        ends[borders - 1] = inside[borders - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        up, down = _power_tables(high - low)
        sums = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: high - low], dtype=np.uint64)
        before = np.where(first > 0, sums[first - 1], np.uint64(0))
        hashes.append(mix((sums[last] - before) * down[first] + (last - first).astype(np.uint64)))
        starts.append(first + low)
        low = high
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)

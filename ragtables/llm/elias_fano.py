"""Elias-Fano code of a non-decreasing sequence: low bits packed, high bits in unary, samples for select."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = "<QBQ"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing sequence of non-negative integers below 2^62: about 2 + log2(last / count) bits each."""
    values = np.asarray(values, np.int64)
    count = len(values)
    if not count:
        return struct.pack(_HEAD, 0, 0, 0)
    width = max(0, int((int(values[-1]) + 1) // count).bit_length() - 1)
    ones = (values >> width) + np.arange(count)
    high = np.zeros(int(ones[-1]) // 8 * 8 + 8, np.uint8)
    high[ones] = 1
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    samples = ones[::SAMPLE].astype("<u4" if ones[-1] < 1 << 32 else "<u8")
    return b"".join((struct.pack(_HEAD, count, width | (samples.itemsize == 8) << 7, len(high) // 8), samples.tobytes(),
                     np.packbits(high, bitorder="little").tobytes(), np.packbits(low.reshape(-1), bitorder="little").tobytes()))


class EliasFano:
    """View of encoded bytes; single values are found without decoding the others."""

    def __init__(self, data, at: int = 0):
        self.count, flags, high = struct.unpack_from(_HEAD, data, at)
        self.width, at = flags & 127, at + struct.calcsize(_HEAD)
        kind = "<u8" if flags & 128 else "<u4"
        self.samples = np.frombuffer(data, kind, -(-self.count // SAMPLE), at)
        at += self.samples.nbytes
        self.high = np.frombuffer(data, np.uint8, high, at)
        at += high
        self.low = np.frombuffer(data, np.uint8, -(-self.count * self.width // 8), at)
        self.end = at + self.low.nbytes

    def select(self, i: int) -> int:
        """Value number ``i``: from the nearest sample, bits are counted in bytes up to the i-th one."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        one = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, one // 8
        first = int(self.high[byte]) >> one % 8 << one % 8
        ones = int(_ONES[first])
        while ones <= left:
            left, byte = left - ones, byte + 1
            first = int(self.high[byte])
            ones = int(_ONES[first])
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(np.array([first], np.uint8), bitorder="little"))[left])
        return (place - i) << self.width | self._low(i)

    def select_run(self, first: int, last: int) -> np.ndarray:
        """Values number ``first`` to ``last - 1``: bits are read from the sample before the first to the one after the last."""
        if not 0 <= first <= last <= self.count:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.int64)
        number = first // SAMPLE
        begin = int(self.samples[number]) // 8
        after = (last - 1) // SAMPLE + 1
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")).astype(np.int64) + begin * 8
        ones = ones[np.searchsorted(ones, int(self.samples[number])) :][first - number * SAMPLE : last - number * SAMPLE]
        bit, stop = first * self.width, last * self.width
        bits = np.unpackbits(self.low[bit // 8 : -(-stop // 8)], bitorder="little")[bit % 8 : bit % 8 + stop - bit]
        low = bits.reshape(last - first, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return (ones - np.arange(first, last)) << self.width | low

    def _low(self, i: int) -> int:
        begin = i * self.width
        part = int.from_bytes(self.low[begin // 8 : (begin + self.width + 7) // 8].tobytes(), "little")
        return part >> begin % 8 & (1 << self.width) - 1

    def decode(self) -> np.ndarray:
        """All values."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.int64) - np.arange(self.count)
        bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.width].reshape(self.count, self.width)
        return high << self.width | bits.astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))

"""Elias-Fano code of a non-decreasing sequence, with select.

``n`` values up to ``u`` take about ``2 + log2(u / n)`` bits each: the low bits
stand in a packed array, the high bits in unary in a bit vector. ``select(i)``
finds the i-th one of that vector from a sample for every 512th one, so no
table of 64-bit offsets is needed.

Layout, little-endian: n (u64), base (i64), low bits (u8), length of the high
bytes (u64), high bytes, packed low bytes. The samples are made on reading.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QqBQ")
_SAMPLE = 512
_BLOCK = 1 << 14


def encode(values: np.ndarray) -> bytes:
    """The code of ``values`` (int64, non-decreasing)."""
    values = np.asarray(values, dtype=np.int64)
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    if (values[1:] < values[:-1]).any():
        raise ValueError("the sequence decreases")
    base = int(values[0])
    gaps = (values - np.int64(base)).view(np.uint64)
    top = int(gaps[-1])
    low = max(0, (top // n).bit_length() - 1) if top >= n else 0
    ones = (gaps >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
    high = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    high[ones.astype(np.int64)] = 1
    packed = []
    for at in range(0, n if low else 0, _BLOCK):  # a block fills whole bytes
        bits = (gaps[at : at + _BLOCK, None] >> np.arange(low, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
        packed.append(np.packbits(bits.reshape(-1), bitorder="little").tobytes())
    vector = np.packbits(high, bitorder="little").tobytes()
    return _HEAD.pack(n, base, low, len(vector)) + vector + b"".join(packed)


class EliasFano:
    """Reader of :func:`encode`'s bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.base, self.low, size = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        self._high = np.frombuffer(data, np.uint8, size, at)
        at += size
        size = (self.n * self.low + 7) // 8
        self._low = np.frombuffer(data, np.uint8, size, at)
        self.end = at + size
        self._rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self._high), dtype=np.int64)])[:: _SAMPLE // 8]

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self._rank, i, side="right")) - 1
        first = block * (_SAMPLE // 8)
        bits = np.unpackbits(self._high[first : first + _SAMPLE // 8], bitorder="little")
        one = first * 8 + int(np.flatnonzero(bits)[i - int(self._rank[block])])
        return self.base + (((one - i) << self.low) | self._low_bits(i, i + 1)[0].item())

    def select_range(self, first: int, last: int) -> np.ndarray:
        """The values from the first-th up to the last-th (exclusive); only the blocks that hold them are decoded."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, dtype=np.int64)
        begin, end = (int(np.searchsorted(self._rank, i, side="right")) - 1 for i in (first, last - 1))
        at = begin * (_SAMPLE // 8)
        bits = np.unpackbits(self._high[at : (end + 1) * (_SAMPLE // 8)], bitorder="little")
        skip = first - int(self._rank[begin])
        ones = at * 8 + np.flatnonzero(bits)[skip : skip + last - first]
        high = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low)
        return (high | self._low_bits(first, last)).view(np.int64) + np.int64(self.base)

    def _low_bits(self, first: int, last: int) -> np.ndarray:
        if not self.low or last <= first:
            return np.zeros(last - first, dtype=np.uint64)
        start, stop = first * self.low, last * self.low
        bits = np.unpackbits(self._low[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start]
        weights = np.uint64(1) << np.arange(self.low, dtype=np.uint64)
        return (bits.reshape(-1, self.low).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

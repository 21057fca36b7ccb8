"""Elias-Fano coding of a non-decreasing sequence, with select.

n values below a bound u take about 2 + log2(u / n) bits each: the low bits of
every value side by side, the high bits in unary. Every SAMPLE-th one of the
unary part has its place stored in 32 bits, so that a
value is found by a short scan, without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBQQ")  # values, bound, low bits, bytes of low, bytes of high
_U64 = np.uint64


class EliasFano:
    def __init__(self, n: int, bound: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.bound, self.low_bits, self.low, self.high, self.samples = n, bound, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: non-negative and non-decreasing."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & _U64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> _U64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bound, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.bound, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bound, low_bits, n_low, n_high = _HEAD.unpack_from(data)
        at = _HEAD.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, bound, low_bits, low, high, np.frombuffer(data, "<u4", -(-n // SAMPLE), at + n_low + n_high))

    def _low(self, first: int, count: int) -> np.ndarray:
        begin, end = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 : begin % 8 + end - begin]
        return (bits.reshape(count, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """The values first .. first + count - 1, from the nearest stored place on."""
        if count <= 0:
            return np.zeros(0, np.int64)
        if first < 0 or first + count > self.n:
            raise IndexError(first)
        sample = first // SAMPLE
        begin = int(self.samples[sample])
        last = (first + count - 1) // SAMPLE + 1
        end = int(self.samples[last]) + 1 if last < len(self.samples) else 8 * len(self.high)
        unary = np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")
        ones = np.flatnonzero(unary[begin % 8 :]) + begin
        ones = ones[first - sample * SAMPLE :][:count]
        high = (ones - np.arange(first, first + count)).astype(np.uint64)
        return ((high << _U64(self.low_bits)) | self._low(first, count)).astype(np.int64)

"""Elias-Fano coding of ascending integers, with select structures.

Of each value the low bits are packed as they are; the high bits are gaps in unary,
so that value i is (position of the i-th one - i) << low | its low bits. The position
of every SAMPLE-th one is kept, so a select reads a few bytes.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQII")


def encode(values: np.ndarray) -> bytes:
    """Ascending values of 0 or more."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    upper[ones] = 1
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    lower, upper = np.packbits(bits, bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes()
    return _HEAD.pack(n, len(upper), low, len(samples) // 4) + samples + lower + upper


class EliasFano:
    def __init__(self, raw: bytes):
        self.n, upper, self.low, samples = _HEAD.unpack_from(raw)
        at = _HEAD.size
        self.samples = np.frombuffer(raw, "<u4", samples, at)
        at += 4 * samples
        lower = (self.n * self.low + 7) // 8
        self.lower = np.frombuffer(raw, np.uint8, lower, at)
        self.upper = np.frombuffer(raw, np.uint8, upper, at + lower)

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        start = i * self.low
        window = int.from_bytes(self.lower[start // 8 : (start + self.low + 7) // 8].tobytes(), "little")
        return window >> start % 8 & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """Value i, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        lacking, byte = i % SAMPLE, start // 8
        bits = np.unpackbits(self.upper[byte : byte + 1], bitorder="little")
        bits[: start % 8] = 0
        while True:
            ones = np.flatnonzero(bits)
            if lacking < len(ones):
                return (byte * 8 + int(ones[lacking]) - i) << self.low | self._low(i)
            lacking -= len(ones)
            byte += 1
            bits = np.unpackbits(self.upper[byte : byte + 1], bitorder="little")

    def selects(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1, from the nearest sample on; nothing else is decoded."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.int64)
        start, last = int(self.samples[a // SAMPLE]), -(-b // SAMPLE)
        byte, end = start // 8, int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.upper)
        ones = np.flatnonzero(np.unpackbits(self.upper[byte:end], bitorder="little")) + byte * 8
        ones = ones[ones >= start][a % SAMPLE :][: b - a]
        found = (ones - np.arange(a, b)).astype(np.int64) << self.low
        if self.low:
            first, end = a * self.low, b * self.low
            bits = np.unpackbits(self.lower[first // 8 : (end + 7) // 8], bitorder="little")[first % 8 :][: end - first].reshape(b - a, self.low)
            found |= (bits.astype(np.int64) << np.arange(self.low)).sum(1)
        return found

    def values(self) -> np.ndarray:
        """All values."""
        return self.selects(0, self.n)

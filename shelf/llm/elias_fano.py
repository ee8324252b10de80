"""Elias-Fano lists of rising numbers: near-minimal space, any element found without a table of offsets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAMPLE = 256
#: ones in every byte, and the place of the k-th one in a byte
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


@dataclass(frozen=True)
class EliasFano:
    """``n`` numbers up to ``most``: ``low_bits`` of each are packed, the rest are gaps in unary.

    ``samples`` holds the bit position of every 256th one of ``high``, so ``select`` reads a few
    dozen bytes wherever the element lies.
    """

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return EliasFano(0, 0, b"", b"", b"")
        low_bits = max(0, int(values[-1]) // n).bit_length() - 1 if values[-1] >= n else 0
        lows = (values[:, None] >> np.arange(low_bits)) & 1
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        return EliasFano(n, low_bits, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes(),
                         np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        part = int.from_bytes(self.low[first // 8:(last + 7) // 8], "little")
        return (part >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The ``i``-th number, counted from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left = i % SAMPLE
        byte, bits = at // 8, self.high[at // 8] >> (at % 8)
        shift = at
        while (ones := int(ONES[bits])) <= left:
            left -= ones
            byte += 1
            bits, shift = self.high[byte], byte * 8
        while True:
            if bits & 1:
                if not left:
                    break
                left -= 1
            bits >>= 1
            shift += 1
        return ((shift - i) << self.low_bits) | self._low(i)

    def decode(self) -> np.ndarray:
        """All numbers."""
        if not self.n:
            return np.empty(0, np.int64)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        lows = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        return ((places - np.arange(self.n)) << self.low_bits) | (lows.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

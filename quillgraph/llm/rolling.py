"""Hashes of stretches of text, many at once, and sets of hashes as bits.

The texts of a batch are laid end to end. With prefix sums of a polynomial modulo 2**64 over mixed code
points, the hash of any stretch is one difference and one product, whatever its length. Equal stretches have
equal hashes wherever they stand; that unequal ones are apart is left to whoever uses the hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each hash it holds, and the least and the greatest size of a filter as powers of two (64 MB).
BITS_PER_HASH = 32
LEAST_BITS, MOST_BITS = 20, 29

_BASE = 0x9E3779B97F4A7C15
_BUCKET = 32768  # bits that Spark's bitmap functions pack into a row


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 15)
            both = []
            for b in (_BASE, pow(_BASE, -1, 1 << 64)):
                a = np.full(self.n, b, np.uint64)
                a[0] = 1
                both.append(np.cumprod(a, dtype=np.uint64))
            self.up, self.down = both
        return self.up, self.down


_POWERS = _Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Stretches:
    """Hashes of the stretches of a sequence of code points."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self._down = _POWERS.get(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(_BASE)) * up[:n], dtype=np.uint64, out=self._sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def windows(self, size: int) -> np.ndarray:
        """Of the windows of ``size`` at every place."""
        n = max(0, len(self._sums) - size)
        return mix((self._sums[size:] - self._sums[:n]) * self._down[:n])


def text_hashes(texts: list[str]) -> np.ndarray:
    """The hash of each whole text: as that of a stretch with the same characters."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    return Stretches(code_points("".join(texts))).between(starts, ends)


@lru_cache(1)
def word_table() -> np.ndarray:
    """Whether a code point is a letter, a digit or an underscore."""
    return np.fromiter((chr(i).isalnum() or i == 0x5F for i in range(0x110000)), bool, 0x110000)


def filter_bits(n: int) -> int:
    """Size of a filter for ``n`` hashes, as a power of two: within fixed bounds, whatever ``n``."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, n) * BITS_PER_HASH - 1).bit_length()))


def bit_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A filter of the ``n`` hashes of column ``h``: two bits for each.

    It lets every hash of the set pass and few others (at most 1 in 250 up to 16 million hashes; beyond, more of
    them, as its size is bounded). The rows collected are 2**filter_bits(n) / 32768 of 4 KB.
    """
    bits = filter_bits(n)
    ends = F.array(F.col("h").bitwiseAND((1 << bits) - 1), F.shiftrightunsigned("h", 64 - bits))
    slots = hashes.select(F.explode(ends).alias("at")).select((F.col("at") + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in slots.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():
        part = np.frombuffer(row["bits"], np.uint8)
        at = (row["bucket"] - 1) * (_BUCKET // 8)
        out[at : at + len(part)] = part
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets pass."""
    size = 8 * len(bits)
    low, high = hashes & np.uint64(size - 1), hashes >> np.uint64(65 - size.bit_length())
    out = np.ones(len(hashes), bool)
    for at in (low.astype(np.int64), high.astype(np.int64)):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out

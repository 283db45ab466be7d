"""Elias-Fano sequences in numpy: rising numbers in about two bits each beyond their lowest bits, asked in whole arrays."""

from __future__ import annotations

import numpy as np

# Bits that one entry of the directory counts.
BLOCK = 512


def _select_table() -> np.ndarray:
    """The place of the k-th one of each byte."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    table = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        ones = np.flatnonzero(bits[byte])
        table[byte, : len(ones)] = ones
    return table


SELECT = _select_table().ravel()


# Lanes of 8 and 16 bits of a number of 64: a one in each, the highest bit of each, 64 in each, and single bits, pairs
# and nibbles.
ONES8, TOP8, FULL8 = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0x4040404040404040)
ONES16, TOP16, LOW16 = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000), np.uint64(0x00FF00FF00FF00FF)
BITS, PAIRS, NIBBLES = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
U1, U2, U3, U4, U8, U16, U63, BYTE = (np.uint64(n) for n in (1, 2, 3, 4, 8, 16, 63, 255))


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
    """The place of the k-th one or zero, counted from 0. ``before`` counts those before each block.

    Running counts of the eight words of a block, and of the eight bytes of a word, lie in the lanes of one number; a
    subtraction in all lanes and the bits it leaves tell how many of them come before the k-th.
    """
    block = np.searchsorted(before, k, "right") - 1
    rest = (k - before[block]).astype(np.uint64)
    parts = words.reshape(-1, BLOCK // 64).take(block, axis=0)
    counts = np.bitwise_count(parts).view(np.uint64).ravel()
    if not ones:
        counts = FULL8 - counts
    even = counts & LOW16
    upto = (even + (counts >> U8 & LOW16)) * ONES16
    pair = np.bitwise_count(((rest * ONES16 | TOP16) - upto) & TOP16).astype(np.uint64)
    shift = pair << U4
    rest = rest - (((upto << U16) >> shift) & np.uint64(0xFFFF))
    first = (even >> shift) & BYTE
    second = rest >= first
    rest = rest - first * second
    word = (pair << U1 | second).view(np.int64)
    bits = parts.ravel().take(np.arange(0, parts.size, BLOCK // 64) + word)
    if not ones:
        bits = ~bits
    octets = bits - (bits >> U1 & BITS)
    octets = (octets & PAIRS) + (octets >> U2 & PAIRS)
    upto = ((octets + (octets >> U4)) & NIBBLES) * ONES8
    octet = np.bitwise_count(((rest * ONES8 | TOP8) - upto) & TOP8).astype(np.uint64)
    shift = octet << U3
    rest = rest - (((upto << U8) >> shift) & BYTE)
    return block * BLOCK + word * 64 + shift.view(np.int64) + SELECT.take(((bits >> shift & BYTE) << U3 | rest).view(np.int64))


def _ones_from(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many ones stand in a row from each place on: 64 stands for 64 or more."""
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    window = words[np.minimum(word, len(words) - 1)] >> shift
    # A row of ones ends with a zero in the last word at the latest, so what is taken from there twice counts for nothing.
    window |= (words[np.minimum(word + 1, len(words) - 1)] << U1) << (U63 - shift)
    return np.where(word < len(words), np.bitwise_count(window & ~(window + U1)), 0).astype(np.int64)


class Rising:
    """A sequence of numbers that never fall, kept in four arrays: see :meth:`arrays`."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> None:
        self.size, self.low_bits, self.low, self.high, self.before = size, low_bits, low, high, before
        self.zeros_before = np.arange(len(before), dtype=np.int64) * BLOCK - before
        self.buckets = len(high) * 64 - size

    @classmethod
    def of(cls, values: np.ndarray) -> Rising:
        values = values.astype(np.uint64)
        size = len(values)
        top = int(values[-1]) if size else 0
        low_bits = max(0, (top // max(1, size)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        places = high + np.arange(size)
        length = (int(places[-1]) if size else 0) + 2
        bits = np.zeros(-(-length // BLOCK) * BLOCK, np.uint8)
        bits[places] = 1
        counts = bits.reshape(-1, BLOCK).sum(1, dtype=np.int64)
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros(size * low_bits // 64 + 2, np.uint64)
        if low_bits and size:
            at = np.arange(size, dtype=np.int64) * low_bits
            value = values & np.uint64((1 << low_bits) - 1)
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            low[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
            # What does not fit the word stands at the beginning of the next one.
            over = np.flatnonzero((at & 63) + low_bits > 64)
            low[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
        return cls(size, low_bits, low, words, np.cumsum(counts) - counts)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.size, self.low_bits], np.int64), self.low, self.high, self.before]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> Rising:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).view(np.uint64)
        value = self.low.take(word) >> shift
        value |= (self.low.take(word + 1) << U1) << (U63 - shift)
        return (value & np.uint64((1 << self.low_bits) - 1)).view(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        if not len(i):
            return np.zeros(0, np.int64)
        high = _select(self.high, self.before, i, True) - i
        return (high << self.low_bits) | self._low(i)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many numbers have smaller high bits, and how many have smaller or the same."""
        asked = np.minimum(high, self.buckets) - 1
        place = _select(self.high, self.zeros_before, np.maximum(asked, 0), False)
        first = np.where(high > 0, place - np.maximum(asked, 0), 0)
        same = _ones_from(self.high, np.where(high > 0, place + 1, 0))
        # The ones of a bucket end with its zero; long rows of ones are followed to there.
        long = np.flatnonzero(same == 64)
        if len(long):
            after = np.minimum(high[long], self.buckets - 1)
            same[long] = _select(self.high, self.zeros_before, after, False) - after - first[long]
        return first, first + same

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number of at least x, and whether it is x; the size where there is none."""
        if not self.size or not len(x):
            return np.full(len(x), self.size), np.zeros(len(x), bool)
        high = x >> self.low_bits
        first, last = self._bucket(high)
        wanted = x & ((1 << self.low_bits) - 1)
        low, up, same = first.copy(), last, np.zeros(len(x), bool)
        # All searches halve their stretch together: only numbers of the same high bits are compared.
        open_ = np.flatnonzero(low < up)
        below, above, wanted = low[open_], up[open_], wanted[open_]
        while len(open_):
            middle = (below + above) >> 1
            found = self._low(middle)
            less = found < wanted
            same[open_[found == wanted]] = True
            below, above = np.where(less, middle + 1, below), np.where(less, above, middle)
            low[open_] = below
            left = np.flatnonzero(below < above)
            open_, below, above, wanted = open_[left], below[left], above[left], wanted[left]
        return low, same

"""Elias-Fano sequences: sorted whole numbers in about 2 + log2(range / n) bits each, searched in place."""

from __future__ import annotations

import functools

import numpy as np

ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
# One in each byte of a word, and the place of the n-th set bit of a byte at 8 * byte + n.
BYTES = np.uint64(0x0101010101010101)
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[n] for b in range(256) for n in range(8)], np.int64)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """`bits` low bits of each value, end to end in 64-bit words."""
    words = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if not bits or not len(values):
        return words
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    # Values that end in one word never overlap there, so sums are unions.
    heads = values << shift
    tails = np.where(shift > np.uint64(64 - bits), values >> np.minimum(np.uint64(64) - shift, np.uint64(63)), np.uint64(0))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] = np.bitwise_or.reduceat(heads, first)
    over = tails != 0
    words[word[over] + 1] |= tails[over]
    return words


def unpack(words: np.ndarray, bits: int, index: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((words[word] >> shift) | high) & (ALL >> np.uint64(64 - bits))


def _nth_one(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th (from 0) set bit of each word."""
    n = n.astype(np.uint64)
    # Each byte of `ones`: the set bits of the word up to its end.
    ones = np.bitwise_count(word.view(np.uint8)).view(np.uint64) * BYTES
    # Bytes that end before the n-th set bit keep their top bit.
    top = BYTES << np.uint64(7)
    place = np.bitwise_count((n * BYTES | top) - ones & top).astype(np.uint64) << np.uint64(3)
    n -= ((ones << np.uint64(8)) >> place) & np.uint64(255)
    byte = (word >> place) & np.uint64(255)
    return place.astype(np.int64) + IN_BYTE[(byte << np.uint64(3) | n & np.uint64(7)).astype(np.int64)]


class EliasFano:
    """A sorted sequence of distinct or repeated values; its arrays may be slices of a memory-mapped file."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(at[-1]) if n else 0) + 2
        high = np.packbits(np.bincount(at, minlength=-(-size // 64) * 64).astype(np.uint8), bitorder="little").view(np.uint64)
        ones = np.cumsum(np.bitwise_count(high).astype(np.int64))
        zeros = np.arange(len(high)) * 64 - np.concatenate([[0], ones[:-1]])
        return cls(n, bits, pack(values & ((ONE << np.uint64(bits)) - ONE), bits), high, zeros)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _nth_one(~self.high[word], k - self.zeros[word])

    def _range(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index range of the values with these high parts (within the sequence's own)."""
        after = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0)
        begin = after - high
        # The values are the ones up to the next zero, which mostly stands in the same word.
        rest = ~self.high[after >> 6] >> (after & 63).astype(np.uint64)
        end = begin + np.bitwise_count((rest & (~rest + ONE)) - ONE)
        far = np.flatnonzero(rest == 0)
        end[far] = self._zero(high[far]) - high[far]
        return begin, end

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x; n if there is none."""
        return self._search(np.asarray(x, np.uint64))[0]

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= x (n if there is none), and whether that value is x.

        The low bits are compared inside the run of values that share the high part, so equal low bits there mean x itself.
        """
        out, equal = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        if not self.n:
            return out, equal
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        total = len(self.high) * 64 - self.n
        near = np.flatnonzero(high < total)
        low = x[near] & ((ONE << np.uint64(self.bits)) - ONE)
        begin, end = self._range(high[near])
        begin, end = np.minimum(begin, self.n), np.minimum(end, self.n)
        last, open_ = end.copy(), np.flatnonzero(begin < end)
        while len(open_):
            mid = (begin[open_] + end[open_]) >> 1
            less = unpack(self.low, self.bits, mid) < low[open_]
            begin[open_] = np.where(less, mid + 1, begin[open_])
            end[open_] = np.where(less, end[open_], mid)
            open_ = open_[begin[open_] < end[open_]]
        out[near] = begin
        inside = np.flatnonzero(begin < last)
        equal[near[inside]] = unpack(self.low, self.bits, begin[inside]) == low[inside]
        return out, equal

    @functools.cached_property
    def _ones(self) -> np.ndarray:
        """Ones before each word of the high bits."""
        return np.arange(len(self.zeros)) * 64 - self.zeros

    def access(self, index: np.ndarray) -> np.ndarray:
        """Values at the indexes."""
        index = np.asarray(index, np.int64)
        ones = self._ones
        word = np.searchsorted(ones, index, "right") - 1
        place = word * 64 + _nth_one(self.high[word], index - ones[word])
        return ((place - index).astype(np.uint64) << np.uint64(self.bits)) | unpack(self.low, self.bits, index)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of x, or -1; with a range given, only inside it."""
        i, ok = self._search(np.asarray(x, np.uint64))
        if begin is not None:
            ok &= (i >= begin) & (i < end)
        return np.where(ok, i, -1)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.zeros]

    @classmethod
    def from_arrays(cls, head, low, high, zeros) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, zeros)


def to_bytes(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 1- or 8-byte items behind a table of (item size, kind, length); each begins at a multiple of 8."""
    kinds = {"u": 0, "i": 1, "f": 2}
    head = [len(arrays)] + [v for a in arrays for v in (a.dtype.itemsize, kinds[a.dtype.kind], len(a))]
    parts = [np.array(head, np.int64).tobytes()]
    for a in arrays:
        raw = a.tobytes()
        parts.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(parts)


def from_buffer(buffer: np.ndarray) -> list[np.ndarray]:
    """The arrays as views of a byte array, such as a memory map."""
    count = int(buffer[:8].view(np.int64)[0])
    head = buffer[8 : 8 + 24 * count].view(np.int64).reshape(count, 3)
    at, out = 8 + 24 * count, []
    for size, kind, length in head.tolist():
        raw = buffer[at : at + size * length]
        out.append(raw.view(np.dtype(f"{'uif'[kind]}{size}")))
        at += -(-size * length // 8) * 8
    return out

"""Compact sorted files in the shared folder: Elias-Fano sequences over memory-mapped arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from flowkeel.llm.store import map_file, write_file

BLOCK_WORDS = 4
ONE = np.uint64(1)


def pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Fields of `bits` bits in 64-bit words, with one word more for reading past the end."""
    n = len(values)
    out = np.zeros(n * bits // 64 + 2, np.uint64)
    if not bits or not n:
        return out
    at = np.arange(n, dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero((at & 63) + bits > 64)
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out


def read_bits(words: np.ndarray, i: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), np.uint64)
    at = i * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = words[word] >> shift
    out |= (words[word + 1] << ONE) << (np.uint64(63) - shift)
    return out & np.uint64((1 << bits) - 1) if bits < 64 else out


_PAIRS, _FOURS, _BYTES = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F))
_EACH, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the n-th set bit of a byte, for all bytes and n below 8.
_IN_BYTE = np.array([[([k for k in range(8) if byte >> k & 1] + [0] * 8)[n] for n in range(8)] for byte in range(256)], np.uint8).ravel()


def nth_bit(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th set bit, counted from 0, of each word: its byte by sums of bytes, then by table."""
    n = n.astype(np.uint64)
    sums = word - ((word >> ONE) & _PAIRS)
    sums = (sums & _FOURS) + ((sums >> np.uint64(2)) & _FOURS)
    sums = ((sums + (sums >> np.uint64(4))) & _BYTES) * _EACH
    at = np.bitwise_count((((n * _EACH) | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)
    n -= (sums << np.uint64(8)) >> at & np.uint64(255)
    return at.astype(np.int64) + _IN_BYTE[(((word >> at) & np.uint64(255)) << np.uint64(3)) | n]


@dataclass
class Sequence:
    """An ascending sequence of 64-bit numbers below `top`."""

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    #: Set bits of `high` before each block of `BLOCK_WORDS` words.
    ones: np.ndarray

    def __post_init__(self):
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * (64 * BLOCK_WORDS) - self.ones

    @staticmethod
    def of(values: np.ndarray, top: int) -> Sequence:
        n = len(values)
        bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        upper = (values >> np.uint64(bits)).astype(np.int64) if bits < 64 else np.zeros(n, np.int64)
        set_at = upper + np.arange(n)
        buckets = (max(1, top) - 1 >> bits) + 1
        size = n + buckets
        words = -(-((size >> 6) + 2) // BLOCK_WORDS) * BLOCK_WORDS
        high = np.zeros(words, np.uint64)
        if n:
            word = set_at >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            high[word[first]] = np.bitwise_or.reduceat(ONE << (set_at & 63).astype(np.uint64), first)
        low = pack_bits(values & np.uint64((1 << bits) - 1), bits)
        count = np.bitwise_count(high).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        return Sequence(n, bits, low, high, np.cumsum(count) - count)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.ones]

    @staticmethod
    def load(next_array: Callable) -> Sequence:
        n, bits = next_array(np.int64).tolist()
        return Sequence(n, bits, next_array(np.uint64), next_array(np.uint64), next_array(np.int64))

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit place of the k-th one or zero: its block by binary search, then word by word."""
        before = self.ones if one else self.zeros
        block = np.searchsorted(before, k, "right") - 1
        left = k - before[block]
        flip = np.uint64(0) if one else np.uint64(0xFFFFFFFFFFFFFFFF)
        w = block * BLOCK_WORDS
        word = self.high[w] ^ flip
        count = np.bitwise_count(word).astype(np.int64)
        far = np.flatnonzero(left >= count)
        while len(far):
            left[far] -= count[far]
            w[far] += 1
            word[far] = self.high[w[far]] ^ flip
            count[far] = np.bitwise_count(word[far])
            far = far[left[far] >= count[far]]
        return (w << 6) + nth_bit(word, left)

    def after(self, at: np.ndarray, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit place of the k-th one or zero, given the place of the one before it."""
        flip = np.uint64(0) if one else np.uint64(0xFFFFFFFFFFFFFFFF)
        w = at >> 6
        word = (self.high[w] ^ flip) >> (at & 63).astype(np.uint64)
        word = (word >> ONE) << ONE
        out = at + np.bitwise_count((word & (np.uint64(0) - word)) - ONE)
        beyond = np.flatnonzero(word == 0)
        if len(beyond):
            # Mostly the next word has it.
            w = w[beyond] + 1
            word = self.high[w] ^ flip
            out[beyond] = (w << 6) + np.bitwise_count((word & (np.uint64(0) - word)) - ONE)
            far = beyond[word == 0]
            if len(far):
                out[far] = self.select(k[far], one)
        return out

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at i and i + 1."""
        at = self.select(i, True)
        behind = self.after(at, i + 1, True)
        bits = np.uint64(self.bits)
        return (((at - i).astype(np.uint64) << bits) | read_bits(self.low, i, self.bits),
                ((behind - i - 1).astype(np.uint64) << bits) | read_bits(self.low, i + 1, self.bits))

    def get(self, i: np.ndarray) -> np.ndarray:
        upper = (self.select(i, True) - i).astype(np.uint64)
        return (upper << np.uint64(self.bits)) | read_bits(self.low, i, self.bits)

    def find(self, x: np.ndarray) -> np.ndarray:
        """First place of each number in the sequence, -1 where it is not there. All x must be below top."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        upper = (x >> np.uint64(self.bits)).astype(np.int64) if self.bits < 64 else np.zeros(len(x), np.int64)
        want = x & np.uint64((1 << self.bits) - 1) if self.bits < 64 else x
        low, at = np.zeros(len(x), np.int64), np.full(len(x), -1, np.int64)
        later = np.flatnonzero(upper > 0)
        at[later] = self.select(upper[later] - 1, False)
        low[later] = at[later] - (upper[later] - 1)
        high = np.zeros(len(x), np.int64)
        high[later] = self.after(at[later], upper[later], False) - upper[later]
        zero = np.flatnonzero(upper == 0)
        high[zero] = self.select(upper[zero], False)
        # A bucket may be long, so its low parts are halved, all queries at once.
        todo = np.flatnonzero(low < high)
        end = high.copy()
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            less = read_bits(self.low, middle, self.bits) < want[todo]
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
            todo = todo[low[todo] < high[todo]]
        near = np.flatnonzero(low < end)
        hit = near[read_bits(self.low, low[near], self.bits) == want[near]]
        out[hit] = low[hit]
        return out


def save(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, each behind its byte count and padded to 8 bytes."""
    parts: list = []
    for a in arrays:
        raw = a.tobytes()
        parts += [np.array([len(raw)], np.int64), raw, bytes(-len(raw) % 8)]
    write_file(uri, parts)


def load(uri: str) -> Callable:
    data, at = map_file(uri), 0

    def next_array(dtype) -> np.ndarray:
        nonlocal at
        size = int(np.frombuffer(data, np.int64, 1, at)[0])
        out = np.frombuffer(data, dtype, size // np.dtype(dtype).itemsize, at + 8)
        at += 8 + size + -size % 8
        return out

    return next_array


def by_shard(shard: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The given rows, shard by shard."""
    own = shard[rows].astype(np.uint16 if len(shard) == 0 or shard.max() < 65536 else np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[rows[part[0]]]), rows[part]


def squeeze(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(next(d for d in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(d).max))

"""Vectorised word hashing shared by the operators that run numpy in tasks.

A word is a run of bytes other than ASCII white space, lower-cased A-Z. Its hash is a
64-bit polynomial over random byte values, taken from prefix sums, then mixed: no
Python object is made per word. Two different words share a hash with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
SHINGLE = 5

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_values = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE = _values[LOWER]
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (raw[at[0]:at[-1]], at - at[0]) if len(at) else (raw[:0], np.zeros(1, np.int64))


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 * BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each, one text at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def word_spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text's start."""
    ink = ~space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    cut[-1] = True
    before = np.zeros(len(data), bool)
    before[1:] = ink[:-1]
    start = np.flatnonzero(ink & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = ink[1:]
    end = np.flatnonzero(ink & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, at)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Hash of each of the given ascending, disjoint spans; works block by block."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK_BYTES, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * powers(BASE, hi - lo), out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * powers(BASE_INVERSE, hi - lo)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry than texts)."""
    start, end, first = word_spans(data, at)
    return span_hashes(data, start, end), first


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    text = np.repeat(np.arange(len(n)), count)
    offset = np.concatenate([[0], np.cumsum(count)])
    pos = np.arange(offset[-1]) - offset[text] + first[text]
    h = np.zeros(len(pos), np.uint64)
    factor = powers(0xD6E8FEB86659FD93, k + 1)
    length = np.minimum(n, k)[text]
    for j in range(k):
        use = length > j
        if use.all():
            h += words[pos + j] * factor[j]
        else:
            h[use] += words[pos[use] + j] * factor[j]
    h = mix(h + length.astype(np.uint64) * factor[k])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[fresh], np.searchsorted(text[fresh], np.arange(len(n) + 1))

"""Exact removal of long repeats: every byte inside a 400-byte string that starts anywhere else too.

Each window of 400 bytes is assigned to the smallest 128-byte hash in it, its anchor; the windows
that one anchor serves stand next to each other and span a stretch. Equal windows have
equal anchors, so only stretches of one anchor can hold them. Stretches that are repeated as a
whole are settled by counting 128 bits of hashes. Of an anchor with different stretches, the
stretches are indexed together, each text once: a task sorts their suffixes, keeps the
run-length Burrows-Wheeler transform with the positions at both ends of every run, and
streams the matching statistics: the longest match of a position is compared directly
where a run ends, and is one less than its left neighbour's everywhere else. Windows whose match
reaches 400 bytes are marked.

The texts are scanned three times and never shuffled; what the scans need to know lies in sorted,
memory-mapped files in the shared folder, as for the language model. An anchor with more
than `CROWD` different stretches is not indexed in one task: its windows' hashes are counted
over all tasks instead, which marks the same windows.

Defined cases: null texts are empty. Texts below 400 bytes are kept whole. Rows that repeat
a text, with or without its id, repeat each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkeel.llm import text as T
from flowkeel.llm.compact import Sequence, by_shard, load, save
from flowkeel.session import fresh_path, materialise, ship_package

LENGTH = 400
GRAM = 128
CROWD = 1000
SHARD_BYTES = 16 << 20
SEGMENT = 2 << 20
FLUSH_BYTES = 16 << 20
PLACE_BITS = 23


@dataclass(frozen=True)
class Plan:
    folder: str
    shards: int
    length: int = LENGTH
    gram: int = GRAM
    crowd: int = CROWD

    def uri(self, kind: str, shard: int) -> str:
        return f"{self.folder}/{kind}-{shard:06d}"

    def shard_of(self, h: np.ndarray) -> np.ndarray:
        return ((T.mix(h) >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)


# --- Anchors ----------------------------------------------------------------------------

class Segment:
    """Bytes of several texts, or a part of a long one, with their stretches."""

    def __init__(self, plan: Plan, data: np.ndarray, at: np.ndarray):
        self.data, n = data, len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(T._values[data] * T.powers(T.BASE, n), out=self.sums[1:])
        self.inverse = T.powers(T.BASE_INVERSE, n + 1)
        span = plan.length - plan.gram + 1
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        count = n - plan.length + 1
        if count <= 0:
            self.first = self.last = self.anchor = self.text = np.zeros(0, np.int64)
            return
        grams = self.hash(np.arange(n - plan.gram + 1), plan.gram)
        place = np.arange(len(grams), dtype=np.uint64)
        low = sliding_min((grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place, span)[:count]
        anchor = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        whole = text[:count] == text[plan.length - 1:]
        start = np.flatnonzero(whole)
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (anchor[start[1:]] != anchor[start[:-1]])
        at_new = np.flatnonzero(new)
        self.first = start[at_new]
        self.last = start[np.append(at_new[1:], len(start)) - 1] if len(at_new) else start
        self.anchor = anchor[self.first]
        self.text = text[self.first]

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return T.mix((self.sums[start + length] - self.sums[start]) * self.inverse[start] + np.asarray(length).astype(np.uint64))

    def keys(self, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per stretch: its anchor's hash, its own, and a second one of both."""
        anchor = self.hash(self.anchor, plan.gram)
        size = self.last - self.first + plan.length
        offset = (self.anchor - self.first).astype(np.uint64)
        stretch = T.mix(self.hash(self.first, size) ^ T.mix(offset + (size.astype(np.uint64) << np.uint64(32))))
        return anchor, T.mix(anchor * np.uint64(3) + stretch), T.mix(stretch + np.uint64(77)) >> np.uint64(16)


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of x[i:i + span] for every i that has so many, by block-wise running minima."""
    n = len(x)
    if n < span:
        return x[:0]
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    block = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - span + 1], ahead[span - 1:n])


def segments(plan: Plan, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[Segment, np.ndarray, np.ndarray]]:
    """Segments with the numbers of their texts and the place in its text at which each begins."""
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > SEGMENT:
            for lo in range(int(at[i]), int(at[i + 1]), SEGMENT):
                hi = min(lo + SEGMENT + plan.length - 1, int(at[i + 1]))
                yield Segment(plan, data[lo:hi], np.array([0, hi - lo])), np.array([i]), np.array([lo - at[i]])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + SEGMENT, "right")) - 1)
        while at[j] - at[j - 1] > SEGMENT and j > i + 1:
            j -= 1
        yield Segment(plan, data[at[i]:at[j]], at[i:j + 1] - at[i]), np.arange(i, j), np.zeros(j - i, np.int64) - (at[i:j] - at[i])
        i = j


# --- Files of settled keys ----------------------------------------------------------------

class Keys:
    """Sorted 64-bit keys with a check value and a number each."""

    def __init__(self, uri: str):
        a = load(uri)
        self.keys = Sequence.load(a)
        self.check, self.value = a(np.uint64), a(np.int64)

    def find(self, keys: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
        """Place of each key, -1 where absent. Keys that differ only in their check stand side by side."""
        at = self.keys.find(keys)
        if check is None:
            return at
        wrong = np.flatnonzero(at >= 0)
        wrong = wrong[self.check[at[wrong]] != check[wrong]]
        while len(wrong):
            at[wrong] += 1
            inside = at[wrong] < self.keys.n
            same = np.zeros(len(wrong), bool)
            same[inside] = self.keys.get(at[wrong[inside]]) == keys[wrong[inside]]
            at[wrong[~same]] = -1
            wrong = wrong[same]
            wrong = wrong[self.check[at[wrong]] != check[wrong]]
        return at


@lru_cache(maxsize=4096)
def keys_file(uri: str) -> Keys:
    return Keys(uri)


def save_keys(uri: str, keys: np.ndarray, check: np.ndarray, value: np.ndarray, *more: np.ndarray) -> None:
    save(uri, [*Sequence.of(keys, 1 << 64).parts(), check.astype(np.uint64), value.astype(np.int64), *more])


def look_up(plan: Plan, kind: str, keys: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in its shard's file (-1 if absent) and its number."""
    at, value = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    shard = plan.shard_of(keys)
    for s, rows in by_shard(shard, np.arange(len(keys))):
        file = keys_file(plan.uri(kind, s))
        at[rows] = file.find(keys[rows], None if check is None else check[rows])
        hit = rows[at[rows] >= 0]
        value[hit] = file.value[at[hit]]
    return at, value


def squeeze(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unsqueeze(block: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def gather(batches: Iterator[pa.RecordBatch], kinds: tuple, what: int = 0) -> tuple[int | None, list[list[np.ndarray]]]:
    """One shard's blocks of a kind."""
    shard, parts = None, []
    for batch in batches:
        for s, k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            shard = s
            if k == what and block.is_valid:
                parts.append(unsqueeze(block.as_buffer(), kinds))
    return shard, parts


def joined(parts: list[list[np.ndarray]], kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def blocks_of(shard: np.ndarray, arrays: list[np.ndarray], what: int = 0) -> pa.RecordBatch:
    out = [(s, squeeze([a[rows] for a in arrays])) for s, rows in by_shard(shard, np.arange(len(shard)))]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([what] * len(out), pa.int8()),
                                       pa.array([b for _, b in out], pa.binary())], names=["shard", "what", "block"])


BLOCK = "shard int, what byte, block binary"
STRETCHES = (np.uint64, np.uint64, np.uint64, np.int64, np.int64)
CROWDS = (np.uint64, np.int64, np.int64)


def fold(key: list[np.ndarray], order_first: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by the key columns, and where each distinct key begins in it."""
    order = np.lexsort(key[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    return order, np.flatnonzero(new)


def totals(key, check, anchor, lead, count):
    order, first = fold([key, check])
    if not len(first):
        return key, check, anchor, lead, count
    return (key[order[first]], check[order[first]], anchor[order[first]],
            np.minimum.reduceat(lead[order], first), np.add.reduceat(count[order], first))


def text_ids(batch: pa.RecordBatch) -> np.ndarray:
    """A number that a row keeps over all scans; rows that repeat an id and a text share it."""
    ids = np.asarray(batch.column(0).fill_null(-1)).astype(np.uint64)
    hashes = np.asarray(batch.column(1)).view(np.uint64)
    return (T.mix(T.mix(ids) + hashes) >> np.uint64(1)).astype(np.int64)


def count_stretches(plan: Plan):
    """First scan: every stretch's keys, counted per few megabytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in T.blocks(batches, "text"):
            ids = text_ids(batch)
            data, at = T.text_buffers(batch.column(2))
            for seg, texts, _ in segments(plan, data, at):
                anchor, key, check = seg.keys(plan)
                held.append((key, check, anchor, ids[texts[seg.text]] if len(seg.text) else np.zeros(0, np.int64), np.ones(len(key), np.int64)))
                size += 40 * len(key)
            if size >= FLUSH_BYTES:
                rows = totals(*joined(held, STRETCHES))
                yield blocks_of(plan.shard_of(rows[0]), list(rows))
                held, size = [], 0
        if held:
            rows = totals(*joined(held, STRETCHES))
            yield blocks_of(plan.shard_of(rows[0]), list(rows))
    return run


def settle_stretches(plan: Plan):
    """Per shard of stretches: files those that occur more than once, passes on how many each anchor has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = gather(batches, STRETCHES)
        if shard is None:
            return
        key, check, anchor, lead, count = totals(*joined(parts, STRETCHES))
        many = count > 1
        save_keys(plan.uri("whole", shard), key[many], check[many], lead[many])
        order, first = fold([anchor])
        different = np.diff(np.append(first, len(order)))
        single = np.add.reduceat((count == 1)[order].astype(np.int64), first) if len(first) else different
        yield blocks_of(plan.shard_of(anchor[order[first]]), [anchor[order[first]], different, single])
    return run


def settle_anchors(plan: Plan):
    """Per shard of anchors: files those with several stretches of which one occurs once; 1 few, 2 many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = gather(batches, CROWDS)
        if shard is None:
            return
        anchor, different, single = joined(parts, CROWDS)
        order, first = fold([anchor])
        if len(first):
            anchor, different, single = (anchor[order[first]], np.add.reduceat(different[order], first),
                                         np.add.reduceat(single[order], first))
        some = (different > 1) & (single > 0)
        save_keys(plan.uri("anchor", shard), anchor[some], anchor[some], np.where(different[some] > plan.crowd, 2, 1))
        yield done(shard, int(some.sum()))
    return run


def done(shard: int, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": [shard], "n": [n]}, schema=pa.schema([("shard", pa.int32()), ("n", pa.int64())]))


# --- The index ----------------------------------------------------------------------------

def suffix_order(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of all suffixes, each up to the end of its string, by doubling their sorted prefixes."""
    n = len(data)
    at = np.arange(n)
    left = np.minimum(end - at, 7)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key |= np.where(left > k, wide[k:n + k], 0).astype(np.uint64) << np.uint64(8 * (7 - k))
    key |= left.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    starts = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(starts, at, 0))
    step = 7
    longest = int((end - at).max(initial=0))
    while step < longest:
        # Only places whose rank is shared are sorted again, inside the slots of that rank.
        size = np.bincount(rank, minlength=n)
        slot = np.flatnonzero(size[rank[order]] > 1)
        if not len(slot):
            break
        open_ = order[slot]
        beyond = open_ + step
        inside = beyond < end[open_]
        second = np.zeros(len(open_), np.int64)
        second[inside] = rank[beyond[inside]] + 1
        key = rank[open_] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        order[slot] = open_
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        rank[open_] = np.maximum.accumulate(np.where(starts, slot, 0))
        step *= 2
    return order


def common(data: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b."""
    most = np.minimum(end[a] - a, end[b] - b)
    out = np.zeros(len(a), np.int64)
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 32)
    todo = np.flatnonzero(most > 0)
    while len(todo):
        same = view[a[todo] + out[todo]] == view[b[todo] + out[todo]]
        run = np.where(same.all(axis=1), 32, same.argmin(axis=1))
        out[todo] += run
        todo = todo[(run == 32) & (out[todo] < most[todo])]
    return np.minimum(out, most)


@dataclass
class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of many strings, with the text position at both ends of each."""

    letter: np.ndarray
    length: np.ndarray
    head: np.ndarray
    tail: np.ndarray

    @staticmethod
    def of(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> RunLengthIndex:
        order = suffix_order(data, end)
        n = len(order)
        before = np.where(order > 0, data[order - 1].astype(np.int64), 0)
        starts = np.zeros(n + 1, bool)
        starts[first[:-1]] = True
        at_start = starts[order]
        before[at_start] = -1 - order[at_start]  # each string begins behind a mark of its own
        new = np.ones(n, bool)
        new[1:] = before[1:] != before[:-1]
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], n) - 1
        return RunLengthIndex(before[heads], np.diff(np.append(heads, n)), order[heads], order[tails])

    def statistics(self, data: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Longest match of each text position with another one."""
        sample = np.zeros(len(data), np.int64)
        if len(self.head) > 1:
            match = common(data, end, self.head[1:], self.tail[:-1])
            np.maximum.at(sample, self.head[1:], match)
            np.maximum.at(sample, self.tail[:-1], match)
        at = np.arange(len(data))
        return np.maximum(0, np.maximum.accumulate(sample + at) - at) if len(data) else sample


def marked(plan: Plan, strings: list[np.ndarray]) -> list[np.ndarray]:
    """For every string the first and last of each run of window starts that are found elsewhere too."""
    size = np.array([len(s) for s in strings], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    data = np.concatenate(strings) if strings else np.zeros(0, np.uint8)
    end = np.repeat(first[1:], size)
    hit = RunLengthIndex.of(data, first, end).statistics(data, end) >= plan.length if len(data) else np.zeros(0, bool)
    at = np.arange(len(hit))
    begin = np.flatnonzero(hit & (~np.concatenate([[False], hit])[:-1] | np.isin(at, first[:-1])))
    stop = np.flatnonzero(hit & (~np.concatenate([hit, [False]])[1:] | np.isin(at, first[1:] - 1)))
    owner = np.searchsorted(first, begin, "right") - 1
    pairs = np.stack([begin - first[owner], stop - first[owner]], axis=1)
    cuts = np.searchsorted(owner, np.arange(len(strings) + 1))
    return [pairs[cuts[i]:cuts[i + 1]] for i in range(len(strings))]


OPEN = (np.uint64, np.uint64, np.int64, np.uint8)
WINDOWS = (np.uint64, np.int64)


def send_open(plan: Plan):
    """Second scan: the texts of stretches to be indexed, by anchor, and the window hashes of crowded anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes, size = [], [], 0

        def flush():
            if held:
                shard = np.array([h[0] for h in held])
                out = []
                for s, rows in by_shard(shard, np.arange(len(shard))):
                    pick = [held[i] for i in rows]
                    out.append((s, squeeze([np.array([p[1] for p in pick], np.uint64), np.array([p[2] for p in pick], np.uint64),
                                            np.array([len(p[3]) for p in pick], np.int64), np.concatenate([p[3] for p in pick])])))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([0] * len(out), pa.int8()),
                                                  pa.array([b for _, b in out], pa.binary())], names=["shard", "what", "block"])
            if hashes:
                keys, counts = np.unique(np.concatenate(hashes), return_counts=True)
                yield blocks_of(plan.shard_of(keys), [keys, counts.astype(np.int64)], 1)

        for batch in T.blocks(batches, "text"):
            ids = text_ids(batch)
            data, at = T.text_buffers(batch.column(2))
            for seg, texts, _ in segments(plan, data, at):
                if not len(seg.first):
                    continue
                anchor, key, check = seg.keys(plan)
                at_anchor, crowd = look_up(plan, "anchor", anchor)
                some = np.flatnonzero(at_anchor >= 0)
                whole, lead = look_up(plan, "whole", key[some], check[some])
                mine = (whole < 0) | (lead == ids[texts[seg.text[some]]])
                some = some[mine]
                shard = plan.shard_of(anchor[some])
                for i, s in zip(some.tolist(), shard.tolist(), strict=True):
                    if crowd[i] == 1:
                        held.append((s, key[i], check[i], seg.data[seg.first[i]:seg.last[i] + plan.length]))
                        size += int(seg.last[i] - seg.first[i]) + plan.length + 100
                big = some[crowd[some] == 2]
                if len(big):
                    n = seg.last[big] - seg.first[big] + 1
                    start = np.repeat(seg.first[big] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    hashes.append(seg.hash(start, plan.length))
                    size += 8 * len(start)
            if size >= FLUSH_BYTES:
                yield from flush()
                held, hashes, size = [], [], 0
        yield from flush()
    return run


def settle_open(plan: Plan):
    """Per shard: indexes the stretches, files the windows found more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        shard, parts = gather(iter(batches), OPEN, 0)
        if shard is None:
            return
        _, counted = gather(iter(batches), WINDOWS, 1)
        key, check, size, data = joined(parts, OPEN)
        cut = np.concatenate([[0], np.cumsum(size)])
        order, first = fold([key, check])
        pick = order[first]  # a row that repeats another's id sends the same stretch again
        ranges = marked(plan, [data[cut[i]:cut[i + 1]] for i in pick])
        n = np.array([len(r) for r in ranges], np.int64)
        save_keys(plan.uri("part", shard), key[pick], check[pick], np.cumsum(n) - n, n,
                  np.concatenate(ranges).astype(np.int64).ravel() if len(ranges) else np.zeros(0, np.int64))
        window, count = joined(counted, WINDOWS)
        order, first = fold([window])
        window, count = window[order[first]], np.add.reduceat(count[order], first) if len(first) else count
        save_keys(plan.uri("window", shard), window[count > 1], window[count > 1], count[count > 1])
        yield done(shard, len(pick))
    return run


class Parts(Keys):
    def __init__(self, uri: str):
        a = load(uri)
        self.keys = Sequence.load(a)
        self.check, self.value, self.n = a(np.uint64), a(np.int64), a(np.int64)
        self.ranges = a(np.int64).reshape(-1, 2)


@lru_cache(maxsize=4096)
def parts_file(uri: str) -> Parts:
    return Parts(uri)


def repeated(plan: Plan, seg: Segment) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of every marked run in a segment."""
    if not len(seg.first):
        return seg.first, seg.first
    anchor, key, check = seg.keys(plan)
    whole = look_up(plan, "whole", key, check)[0] >= 0
    first, last = [seg.first[whole]], [seg.last[whole]]
    rest = np.flatnonzero(~whole)
    at_anchor, crowd = look_up(plan, "anchor", anchor[rest])
    few, many = rest[crowd == 1], rest[crowd == 2]
    for s, rows in by_shard(plan.shard_of(anchor[few]), np.arange(len(few))):
        file = parts_file(plan.uri("part", s))
        at = file.find(key[few[rows]], check[few[rows]])
        for i, p in zip(few[rows[at >= 0]].tolist(), at[at >= 0].tolist(), strict=True):
            r = file.ranges[file.value[p]:file.value[p] + file.n[p]] + seg.first[i]
            first.append(r[:, 0])
            last.append(r[:, 1])
    if len(many):
        n = seg.last[many] - seg.first[many] + 1
        start = np.repeat(seg.first[many] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = start[look_up(plan, "window", seg.hash(start, plan.length))[0] >= 0]
        first.append(start)
        last.append(start)
    return np.concatenate(first), np.concatenate(last)


OUTPUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_out(plan: Plan, texts_too: bool = False):
    """Third scan: removes the marked bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            data, at = T.text_buffers(batch.column(2))
            edge = np.zeros(len(data) + 1, np.int32)
            for seg, texts, begins in segments(plan, data, at):
                first, last = repeated(plan, seg)
                if len(first):
                    base = int(at[texts[0]] + begins[0])
                    np.add.at(edge, first + base, 1)
                    np.add.at(edge, last + base + plan.length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            begin[at[:-1][at[:-1] < len(data)]] = gone[at[:-1][at[:-1] < len(data)]]
            sums, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begin))
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            out = [batch.column(0), pa.array(np.diff(at)), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(spans[at[1:]] - spans[at[:-1]]),
                   pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = [c.split()[0] for c in OUTPUT.split(", ")]
            if texts_too:
                out.append(pa.array([k.decode("utf-8", "ignore") for k in kept]))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, crowd: int = CROWD,
                   shard_bytes: int = SHARD_BYTES, texts_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) of every row of docs (doc_id, text).

    A removal may cut a character in two; `kept_text` then leaves the cut character out.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(fresh_path(spark, "repeats"), max(1, -(-size // shard_bytes)), length, gram or max(1, length * GRAM // LENGTH), crowd)
    every = spark.range(plan.shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("byte").alias("what"),
                                            F.lit(None).cast("binary").alias("block"))

    def dealt(blocks: DataFrame) -> DataFrame:
        return blocks.union(every).repartitionById(plan.shards, F.col("shard"))

    stretches = dealt(rows.mapInArrow(count_stretches(plan), BLOCK)).mapInArrow(settle_stretches(plan), BLOCK)
    materialise(dealt(stretches).mapInArrow(settle_anchors(plan), "shard int, n long"), "anchors")
    materialise(dealt(rows.mapInArrow(send_open(plan), BLOCK)).mapInArrow(settle_open(plan), "shard int, n long"), "open")
    return rows.mapInArrow(cut_out(plan, texts_too), OUTPUT + (", kept_text string" if texts_too else ""))

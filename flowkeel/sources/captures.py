"""Capture files (pcap and pcapng) as a table of frames.

A capture has no marks to split at. Every range of a file is probed at the same time: a
task guesses the first record of its range from a run of plausible record headers, in pcapng
from blocks whose length stands at both ends, and hops from there to the first record of
the next range. Where each range's guess is the record its predecessor arrived at, the guesses
are proven, because the first range starts at the known first record. What a range of a pcapng
file declares on its way, byte order and time units, then reaches the ranges behind it by a
running list over the file's ranges. A file with any other outcome is walked from its start. Either
way only headers are looked at, and the frames are then read range by range in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowkeel.schema import HEADS_SCHEMA
from flowkeel.session import materialise, ship_package

# File and block formats.
PCAP_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
PCAP_HEADER, RECORD_HEADER = 24, 16
SECTION, INTERFACE, OLD_PACKET, ENHANCED_PACKET = 0x0A0D0D0A, 1, 2, 6
SECTION_BYTES = b"\x0a\x0d\x0d\x0a"
BYTE_ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
OPTION_TSRESOL = 9
DEFAULT_TICKS = 1_000_000

SPLIT_BYTES = 64 << 20
TASKS_PER_CORE = 4
MAX_RECORD = 1 << 18
# Longest block that a guess may start from; longer ones are met by hopping only.
MAX_BLOCK = 1 << 20
# Words that a guess looks at first; it looks further where no run of blocks opens among them.
FIRST_LOOK = 1 << 10
PROOF_RECORDS = 8
# Ethernet header, the longest IPv4 header, and both ports.
HEAD_BYTES = 14 + 60 + 4
BATCH_BYTES = 8 << 20

SPLITS_DDL = ("file string, length bigint, k bigint, kind string, start bigint, stop bigint, "
              "byte_order string, ticks array<bigint>")
# What a probe adds: whether a section begins in the range, and the byte order and time units it leaves behind.
PROBES_DDL = SPLITS_DDL + ", turned boolean, left_order string, left_ticks array<bigint>"


class Cursor:
    """Buffered reads at any offset of a file named by URI."""

    def __init__(self, uri: str, chunk: int = 4 << 20):
        from pyarrow import fs

        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
        self.file = system.open_input_file(path)
        self.length = self.file.size()
        self.chunk, self.at, self.buffer = chunk, 0, b""

    def take(self, offset: int, size: int) -> bytes:
        """`size` bytes, fewer at the end of the file."""
        if offset < self.at or offset + size > self.at + len(self.buffer):
            self.file.seek(min(offset, self.length))
            self.at, self.buffer = offset, self.file.read(max(size, self.chunk))
        return self.buffer[offset - self.at:offset - self.at + size]

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.file.close()


def _pcap_records(cur: Cursor, order: str, start: int, stop: int) -> Iterator[tuple[int, int, int, int, int]]:
    """`(offset, seconds, fraction, captured, on the wire)` of the records in a range."""
    header = struct.Struct(order + "IIII")
    while start < stop:
        raw = cur.take(start, RECORD_HEADER)
        if len(raw) < RECORD_HEADER:
            return
        sec, frac, captured, wire = header.unpack(raw)
        yield start, sec, frac, captured, wire
        start += RECORD_HEADER + captured


def _guess_start(cur: Cursor, order: str, ticks: int, lo: int) -> int:
    """The first offset from `lo` that opens a run of plausible records, or -1."""
    header = struct.Struct(order + "IIII")

    def plausible(offset: int) -> int:
        raw = cur.take(offset, RECORD_HEADER)
        if len(raw) < RECORD_HEADER:
            return -1
        _, frac, captured, wire = header.unpack(raw)
        ok = frac < ticks and captured <= wire and 0 < captured <= MAX_RECORD
        return offset + RECORD_HEADER + captured if ok else -1

    window = cur.take(lo, MAX_RECORD + 2 * RECORD_HEADER)
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(window, "u1"), RECORD_HEADER) \
        if len(window) >= RECORD_HEADER else np.empty((0, RECORD_HEADER), "u1")
    fields = np.ascontiguousarray(words).view(order + "u4")
    frac, captured, wire = fields[:, 1], fields[:, 2], fields[:, 3]
    likely = np.flatnonzero((frac < ticks) & (captured <= wire) & (captured > 0) & (captured <= MAX_RECORD))
    for first in likely.tolist():
        offset = lo + first
        for _ in range(PROOF_RECORDS):
            offset = plausible(offset)
            if offset < 0 or offset == cur.length:
                break
        if offset >= 0:
            return lo + first
    return cur.length if len(window) < RECORD_HEADER else -1


def _section_order(cur: Cursor, offset: int) -> str:
    mark = cur.take(offset + 8, 4)
    if mark not in BYTE_ORDER:
        raise ValueError(f"no byte order mark in the section at {offset}")
    return BYTE_ORDER[mark]


def _interface_ticks(body: bytes, order: str) -> int:
    """Ticks per second an interface declares in its options."""
    at = 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        if code == OPTION_TSRESOL and size >= 1:
            v = body[at + 4]
            return (2 ** (v & 0x7F) if v & 0x80 else 10 ** v) or DEFAULT_TICKS
        at += 4 + size + (-size % 4)
    return DEFAULT_TICKS


def _blocks(cur: Cursor, start: int, stop: int, order: str, ticks: list[int]):
    """`(offset, type, size, byte order, ticks)` per block; `ticks` grows with the interfaces."""
    while start < stop:
        head = cur.take(start, 12)
        if len(head) < 12:
            return
        if head[:4] == SECTION_BYTES:
            order, ticks = _section_order(cur, start), []
        kind, size = struct.unpack_from(order + "II", head)
        if size < 12 or start + size > cur.length:
            return
        if kind == INTERFACE:
            ticks = ticks + [_interface_ticks(cur.take(start + 8, size - 12), order)]
        yield start, kind, size, order, ticks
        start += size


def _walk(cur: Cursor, file: str, split_bytes: int) -> list[tuple]:
    """Splits of a whole file, found from its start."""
    magic = cur.take(0, 4)
    if magic in PCAP_MAGIC:
        order, ticks = PCAP_MAGIC[magic]
        marks = [(PCAP_HEADER, order, [ticks])]
        for offset, *_ in _pcap_records(cur, order, PCAP_HEADER, cur.length):
            if offset - marks[-1][0] >= split_bytes:
                marks.append((offset, order, [ticks]))
        kind = "pcap"
    elif magic == SECTION_BYTES:
        marks = [(0, "<", [])]
        # The state a split starts with is the one before its first block.
        state = ("<", [])
        for offset, _, _, order, ticks in _blocks(cur, 0, cur.length, "<", []):
            if offset - marks[-1][0] >= split_bytes:
                marks.append((offset, *state))
            state = (order, ticks)
        kind = "pcapng"
    else:
        raise ValueError(f"not a capture file: {file}")
    ends = [m[0] for m in marks[1:]] + [cur.length]
    return [(file, cur.length, k, kind, start, end, order, ticks)
            for k, ((start, order, ticks), end) in enumerate(zip(marks, ends))]


def _block_size(cur: Cursor, offset: int, order: str) -> int:
    """The size of a block of which the length at its end agrees, else -1."""
    raw = cur.take(offset, 12)
    if len(raw) < 12:
        return -1
    if raw[:4] == SECTION_BYTES:
        if raw[8:12] not in BYTE_ORDER:
            return -1
        order = BYTE_ORDER[raw[8:12]]
    size = struct.unpack_from(order + "I", raw, 4)[0]
    if size < 12 or size % 4 or offset + size > cur.length:
        return -1
    return size if cur.take(offset + size - 4, 4) == struct.pack(order + "I", size) else -1


def _guess_block(cur: Cursor, lo: int) -> tuple[int, str | None]:
    """The first offset from `lo` that opens a run of whole blocks, and their byte order; -1 if there is none."""
    lo += -lo % 4
    room = min(MAX_BLOCK + 12, cur.length - lo)
    at_word, look = 0, FIRST_LOOK
    while at_word < room // 4 - 1:
        base, n = lo + 4 * at_word, min(look, room // 4 - 1 - at_word)
        words = np.frombuffer(cur.take(base, 4 * n + 4), "<u4")
        found = []
        for order in ("<", ">"):
            sizes = words.view(order + "u4")[1:].astype(np.int64)
            at = np.flatnonzero((sizes >= 12) & (sizes % 4 == 0) & (sizes <= MAX_BLOCK) & (base + 4 * np.arange(len(sizes)) + sizes <= cur.length))
            end = at + sizes[at] // 4 - 1
            seen = end < len(words)
            same = np.ones(len(at), bool)
            same[seen] = words.view(order + "u4")[end[seen]] == sizes[at[seen]]
            found += [(int(i), order) for i in at[same]]
        for first, order in sorted(found):
            offset, own = base + 4 * first, order
            for _ in range(PROOF_RECORDS):
                if cur.take(offset, 4) == SECTION_BYTES and (mark := cur.take(offset + 8, 4)) in BYTE_ORDER:
                    own = BYTE_ORDER[mark]
                size = _block_size(cur, offset, own)
                offset = offset + size if size > 0 else -1
                if offset < 0 or offset == cur.length:
                    break
            if offset >= 0:
                return base + 4 * first, order
        at_word, look = at_word + n, 4 * look
    return (cur.length, None) if room < 12 else (-1, None)


def _probe_blocks(cur: Cursor, file: str, k: int, lo: int, hi: int) -> tuple:
    start, order = (0, "<") if k == 0 else _guess_block(cur, lo)
    if start < 0:
        return (file, cur.length, k, "pcapng", -1, cur.length, None, [], None, None, [])
    if cur.take(start, 4) == SECTION_BYTES:
        order = None  # the block says itself
    stop, turned, ticks, own = start, False, [], order or "<"
    for offset, kind, size, own, ticks in _blocks(cur, start, hi, own, []):
        stop, turned = offset + size, turned or kind == SECTION
    stop = cur.length if hi >= cur.length else stop
    return (file, cur.length, k, "pcapng", start, stop, order, [], turned, own if turned else None, ticks)


def _probe(file: str, k: int, split_bytes: int) -> list[tuple]:
    with Cursor(file, min(4 << 20, max(split_bytes, 4096))) as cur:
        magic = cur.take(0, 4)
        lo, hi = k * split_bytes, min((k + 1) * split_bytes, cur.length)
        if magic == SECTION_BYTES:
            return [_probe_blocks(cur, file, k, lo, hi)]
        if magic not in PCAP_MAGIC:
            raise ValueError(f"not a capture file: {file}")
        order, ticks = PCAP_MAGIC[magic]
        start = PCAP_HEADER if k == 0 else _guess_start(cur, order, ticks, lo)
        stop = cur.length
        if start >= 0 and hi < cur.length:
            stop = start
            for offset, _, _, captured, _ in _pcap_records(cur, order, start, hi):
                stop = offset + RECORD_HEADER + captured
        return [(file, cur.length, k, "pcap", start, stop, order, [ticks], None, None, [])]


def carried(proven: DataFrame) -> DataFrame:
    """pcapng ranges with the byte order and time units in force where they start, and whether their guessed order was right.

    `section` counts the sections that began in earlier ranges; a range's declarations belong to
    the section that it leaves behind. Rows of ranges that declare nothing add nothing to the running lists.
    """
    before = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.col("turned").cast("int")
    entered = proven.withColumn("section", F.coalesce(F.sum(turned).over(before), F.lit(0))).withColumn(
        "order_in", F.coalesce(F.last("left_order", ignorenulls=True).over(before), F.lit("<")))
    rest = [c for c in entered.columns if c not in ("section", "left_ticks")]
    asks = entered.select(F.struct(*rest).alias("range"), "file", "section", "k", F.lit(0).alias("rank"), F.lit(None).cast("array<bigint>").alias("declared"))
    says = entered.filter(F.size("left_ticks") > 0).select(
        F.lit(None).cast(asks.schema["range"].dataType).alias("range"), "file", F.col("section") + turned, "k", F.lit(1), "left_ticks")
    running = Window.partitionBy("file", "section").orderBy("k", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = asks.union(says).withColumn("known", F.flatten(F.collect_list("declared").over(running))).filter(F.col("range").isNotNull())
    right = F.col("range.byte_order").isNull() | (F.col("range.byte_order") == F.col("range.order_in"))
    return known.select(*[f"range.{c}" for c in ("file", "length", "k", "kind", "start", "stop")],
                        F.col("range.order_in").alias("byte_order"), F.col("known").alias("ticks"), right.alias("_right"))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _splits_schema(probed: bool = False) -> pa.Schema:
    more = [("turned", pa.bool_()), ("left_order", pa.string()), ("left_ticks", pa.list_(pa.int64()))] if probed else []
    return pa.schema([("file", pa.string()), ("length", pa.int64()), ("k", pa.int64()), ("kind", pa.string()),
                      ("start", pa.int64()), ("stop", pa.int64()), ("byte_order", pa.string()),
                      ("ticks", pa.list_(pa.int64())), *more])


def _dealt(ranges: DataFrame, size: Column) -> tuple[DataFrame, int]:
    """Ranges of `size` bytes dealt over tasks, and their number: one for each range, but no more than some for each core or a split's bytes ask for.

    Ranges far below a split's size share tasks, whose start would take longer than they do.
    """
    count, total = ranges.agg(F.count("*"), F.sum(size)).first()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(count, max(TASKS_PER_CORE * cores, -(-(total or 0) // SPLIT_BYTES)), 100_000))
    return ranges.repartition(n), n


def index_captures(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Proven ranges of the captures: whole records, in parallel readable."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    files = files.filter(F.col("length") > 0)
    last = F.call_function("div", F.col("length") - 1, F.lit(split_bytes))
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    dealt, n = _dealt(ranges, F.least(F.lit(split_bytes), F.col("length") - F.col("k") * split_bytes))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, k in zip(b.column("file").to_pylist(), b.column("k").to_pylist()):
                yield _table(_probe(file, k, split_bytes), _splits_schema(True))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                with Cursor(file) as cur:
                    yield _table(_walk(cur, file, split_bytes), _splits_schema())

    probed = materialise(dealt.mapInArrow(probe, PROBES_DDL), "capture-probes")
    by_file = Window.partitionBy("file")
    arrived = F.lag("stop").over(by_file.orderBy("k"))
    met = (F.col("start") >= 0) & ((F.col("k") == 0) | (arrived.eqNullSafe(F.col("start"))))
    linked = probed.withColumn("_met", met)
    names = [c.split()[0] for c in SPLITS_DDL.split(", ")]
    plain = linked.filter("kind = 'pcap'").select(*names, F.col("_met").alias("_ok"))
    blocks = carried(linked.filter("kind = 'pcapng'")).withColumnRenamed("_right", "_ok")
    blocks = blocks.join(linked.select("file", "k", "_met"), ["file", "k"]).select(*names, (F.col("_ok") & F.col("_met")).alias("_ok"))
    judged = plain.unionByName(blocks).withColumn("_ok", F.min("_ok").over(by_file))
    good = judged.filter("_ok").drop("_ok")
    doubtful = judged.filter(~F.col("_ok")).groupBy("file").agg(F.max("length").alias("length"))
    walked = doubtful.repartition(min(n, 1000), "file").mapInArrow(walk, SPLITS_DDL)
    return good.unionByName(walked).filter(F.col("start") < F.col("stop"))


def _heads(buffer: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of the given places of a buffer as one Arrow column."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(ends[-1]) + np.repeat(at - ends[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(buffer[index])])


def _microseconds(ticks: np.ndarray, per: int) -> np.ndarray:
    """Times in microseconds, rounded down; Python's integers where 64 bits might not do."""
    if per > 10**12 or (len(ticks) and int(ticks.max()) // per > 2**62 // 1_000_000):
        return np.array([int(t) * 1_000_000 // per for t in ticks], np.int64)
    per = np.uint64(per)
    million = np.uint64(1_000_000)
    return ((ticks // per) * million + (ticks % per) * million // per).astype(np.int64)


FRAMES = pa.schema([("file", pa.string()), ("ord", pa.int64()), ("ts_us", pa.int64()),
                    ("wirelen", pa.int64()), ("frame", pa.binary()), ("caplen", pa.int64())])


def _gathered(split: dict, cur: Cursor, base: int, raw: bytes, at: list[int], order: str, skip: int, ticks: list[int], head: int | None) -> pa.RecordBatch:
    """The packets whose records or blocks start at the given places of a buffer, their fields taken all at once."""
    buffer, at = np.frombuffer(raw, np.uint8), np.array(at, np.int64)
    four = np.ascontiguousarray(buffer[at[:, None] + np.arange(skip)]).view(order + "u4").astype(np.uint64)
    if split["kind"] == "pcap":
        per = ticks[0]
        time = four[:, 0].astype(np.int64) * 1_000_000 + _microseconds(four[:, 1], per)
        captured, wire = four[:, 2], four[:, 3]
    else:
        clock, old = four[:, 3] << np.uint64(32) | four[:, 4], four[:, 0] == OLD_PACKET
        # An old packet block has two halves of a word for interface and drops.
        halves = np.ascontiguousarray(buffer[at[:, None] + np.arange(8, 10)]).view(order + "u2")[:, 0]
        interface = np.where(old, halves, four[:, 2]).astype(np.int64)
        time = np.zeros(len(at), np.int64)
        for one in np.unique(interface):
            own = interface == one
            time[own] = _microseconds(clock[own], ticks[one] if one < len(ticks) else DEFAULT_TICKS)
        captured, wire = four[:, 5], four[:, 6]
    there = np.minimum(captured.astype(np.int64), np.maximum(cur.length - base - at - skip, 0))
    sizes = there if head is None else np.minimum(there, head)
    return pa.RecordBatch.from_arrays([
        pa.array([split["file"]] * len(at), pa.string()), pa.array(base + at), pa.array(time), pa.array(wire.astype(np.int64)),
        _heads(buffer, at + skip, sizes), pa.array(there)], schema=FRAMES)


def _frames(cur: Cursor, split: dict, head: int | None) -> Iterator[pa.RecordBatch]:
    """A split's packets, a buffer at a time. Long frames are hopped over, and nothing behind the file's end is asked for."""
    order, ticks, stop = split["byte_order"], list(split["ticks"]), split["stop"]
    plain = split["kind"] == "pcap"
    header, skip = (RECORD_HEADER, RECORD_HEADER) if plain else (12, 28)
    offset = split["start"]
    wanted = min(BATCH_BYTES, stop - offset)
    while offset < stop:
        raw = cur.take(offset, wanted)
        whole = offset + len(raw) >= cur.length
        at, found, need = 0, [], header
        pair = struct.Struct(order + "II")
        while offset + at < stop and at + header <= len(raw):
            first, second = pair.unpack_from(raw, at + 8 if plain else at)
            if plain:
                step, captured = skip + first, first
            elif first == SECTION or first == INTERFACE:
                if found:
                    break  # what is found goes out under the units it was found under
                if first == SECTION:
                    order, ticks = _section_order(cur, offset + at), []
                    pair = struct.Struct(order + "II")
                    step = pair.unpack_from(raw, at)[1]
                else:
                    step = second
                    ticks = ticks + [_interface_ticks(cur.take(offset + at + 8, max(0, step - 12)), order)]
                captured = None
            else:
                step = second
                captured = None
                if first in (ENHANCED_PACKET, OLD_PACKET) and step >= skip + 4:
                    if at + skip > len(raw) and not whole:
                        need = skip
                        break
                    captured = struct.unpack_from(order + "I", raw, at + 20)[0] if at + skip <= len(raw) else None
            if not plain and (step < 12 or offset + at + step > cur.length):
                stop = offset + at
                break
            if captured is not None:
                need = skip + (captured if head is None else min(captured, head))
                if at + need > len(raw) and not whole:
                    break
                found.append(at)
            at += step
        if found:
            yield _gathered(split, cur, offset, raw, found, order, skip, ticks, head)
        if not at and (whole or need <= wanted):
            return
        offset += at
        wanted = min(BATCH_BYTES, stop - offset) if at else need


def read_frames(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES,
                head: int | None = HEAD_BYTES) -> DataFrame:
    """Frames of all captures a path, list or glob names.

    `ord` is the offset of a frame's record in its file, so it follows file order. `frame` has the
    first `head` bytes, all that decoding needs, or everything with None; `caplen` says how many
    bytes were captured.
    """
    splits = materialise(index_captures(spark, path, split_bytes), "capture-splits")
    dealt, _ = _dealt(splits, F.col("stop") - F.col("start"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for split in b.to_pylist():
                with Cursor(split["file"], min(4 << 20, max(split["stop"] - split["start"], 4096))) as cur:
                    yield from _frames(cur, split, head)

    return dealt.mapInArrow(frames, HEADS_SCHEMA)

"""Capture files of both formats, whole and split."""

import random
import struct

import pytest

from flowkeel.sources import captures
from flowkeel.sources.captures import index_captures, read_frames


def pcap(records, order="<", nano=False, tail=b""):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for sec, frac, wire, data in records:
        out += struct.pack(order + "IIII", sec, frac, len(data), wire) + data
    return out + tail


def block(order, kind, body):
    body += b"\x00" * (-len(body) % 4)
    size = len(body) + 12
    return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)


def section(order):
    return block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface(order, resolution=None):
    options = b"" if resolution is None else struct.pack(order + "HHB", 9, 1, resolution) + b"\x00" * 3
    return block(order, 1, struct.pack(order + "HHI", 1, 0, 65535) + options)


def enhanced(order, ticks, data, iface=0, wire=None):
    head = struct.pack(order + "IIIII", iface, ticks >> 32, ticks & 0xFFFFFFFF, len(data), wire or len(data))
    return block(order, 6, head + data)


def records(n, seed=1):
    rng = random.Random(seed)
    return [(1_700_000_000 + i, rng.randrange(1_000_000), 1000 + i, rng.randbytes(rng.randrange(1, 300)))
            for i in range(n)]


def frames(spark, path, **kw):
    return [(r["ts_us"], r["wirelen"], bytes(r["frame"]))
            for r in read_frames(spark, str(path), head=None, **kw).orderBy("file", "ord").collect()]


def expected(recs):
    return [(s * 1_000_000 + f, w, d) for s, f, w, d in recs]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("split", [1 << 20, 5000])
def test_pcap(spark, tmp_path, order, split):
    recs = records(400)
    (tmp_path / "a.pcap").write_bytes(pcap(recs, order))
    assert frames(spark, tmp_path / "*.pcap", split_bytes=split) == expected(recs)


def test_splits_are_proven_without_walking(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(records(400)))
    splits = index_captures(spark, str(tmp_path), 5000).orderBy("k").collect()
    assert len(splits) > 5
    assert splits[0]["start"] == 24
    assert all(a["stop"] == b["start"] for a, b in zip(splits, splits[1:]))


def test_misleading_payload_falls_back_to_walking(spark, tmp_path):
    """Payloads that look like runs of records put the guesses off, not the result."""
    bait = struct.pack("<IIII", 1_700_000_000, 5, 16, 16) + b"y" * 16
    recs = [(1_700_000_000 + i, i, 10_000, bait * 60) for i in range(60)]
    (tmp_path / "a.pcap").write_bytes(pcap(recs))
    assert frames(spark, tmp_path, split_bytes=3000) == expected(recs)


def test_truncated_tail_keeps_what_is_there(spark, tmp_path):
    recs = records(50)
    tail = struct.pack("<IIII", 1_800_000_000, 7, 100, 100) + b"z" * 40
    (tmp_path / "a.pcap").write_bytes(pcap(recs, tail=tail))
    for split in (1 << 20, 2000):
        got = frames(spark, tmp_path, split_bytes=split)
        assert got == expected(recs) + [(1_800_000_000_000_007, 100, b"z" * 40)]


def test_nanosecond_pcap(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap([(5, 123_456_789, 60, b"abc")], nano=True))
    assert frames(spark, tmp_path) == [(5_123_456, 60, b"abc")]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("split", [1 << 20, 100])
def test_pcapng(spark, tmp_path, order, split):
    ts = 1_700_000_000
    other = "<" if order == ">" else ">"
    data = (
        section(order) + interface(order) + interface(order, 9) + interface(order, 0) + interface(order, 0x80 | 10)
        + enhanced(order, ts * 10**6 + 1, b"micro", wire=99)
        + block(order, 3, struct.pack(order + "I", 4) + b"none")        # carries no time
        + block(order, 0xBAD, b"whatever")
        + enhanced(order, ts * 10**9 + 2_999, b"nano", iface=1)
        + enhanced(order, ts, b"seconds", iface=2)
        + enhanced(order, ts * 1024 + 512, b"binary", iface=3)
        + block(order, 2, struct.pack(order + "HHIIII", 0, 0, *divmod(ts * 10**6 + 3, 1 << 32), 3, 77) + b"old")
        + section(other) + interface(other, 3) + enhanced(other, ts * 1000 + 4, b"next section")
    )
    (tmp_path / "a.pcapng").write_bytes(data)
    us = ts * 10**6
    assert frames(spark, tmp_path, split_bytes=split) == [
        (us + 1, 99, b"micro"), (us + 2, 4, b"nano"), (us, 7, b"seconds"), (us + 500_000, 6, b"binary"),
        (us + 3, 77, b"old"), (us + 4000, 12, b"next section")]


def test_many_files_and_unknown_format(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pcap").write_bytes(pcap(records(20, seed=i)))
    assert frames(spark, tmp_path / "*.pcap") == [f for i in range(3) for f in expected(records(20, seed=i))]
    (tmp_path / "x.bin").write_bytes(b"not a capture")
    with pytest.raises(Exception, match="not a capture file"):
        frames(spark, tmp_path / "x.bin")


def test_header_only_file(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap([]))
    (tmp_path / "b.pcap").write_bytes(b"")
    assert frames(spark, tmp_path) == []


def test_frames_are_heads_by_default(spark, tmp_path):
    recs = records(60)
    (tmp_path / "a.pcap").write_bytes(pcap(recs, "<"))
    rows = read_frames(spark, f"{tmp_path}/*.pcap").orderBy("ord").collect()
    assert [(bytes(r["frame"]), r["caplen"]) for r in rows] == [(d[:78], len(d)) for *_, d in recs]


def many_sections(n, seed=3):
    """pcapng bytes whose sections, byte orders, interfaces and units change along the way, and what they hold."""
    rng = random.Random(seed)
    out, want, order, units = b"", [], "<", []
    for i in range(n):
        if i % 97 == 0:
            order, units = rng.choice("<>"), [10**6]
            out += section(order) + interface(order)
        if rng.random() < 0.05:
            power = rng.choice([0, 3, 9, 12])
            units.append(10**power)
            out += interface(order, power)
        if rng.random() < 0.05:
            out += block(order, 4, rng.randbytes(rng.randrange(60)))
        data, k = rng.randbytes(rng.randrange(200)), rng.randrange(len(units))
        ticks = rng.randrange(2**31) * units[k] + rng.randrange(units[k])
        out += enhanced(order, ticks % 2**64, data, k, 1 + len(data))
        want.append((ticks % 2**64 * 10**6 // units[k], 1 + len(data), data))
    return out, want


@pytest.mark.parametrize("split", [1 << 20, 3000, 700])
def test_pcapng_ranges_carry_what_was_declared(spark, tmp_path, split):
    for k in range(2):
        raw, want = many_sections(500, k)
        (tmp_path / f"{k}.pcapng").write_bytes(raw)
        assert frames(spark, tmp_path / f"{k}.pcapng", split_bytes=split) == want
    splits = index_captures(spark, str(tmp_path), split).orderBy("file", "k").collect()
    assert all(a["stop"] == b["start"] for a, b in zip(splits, splits[1:]) if a["file"] == b["file"])


def test_probes_of_pcapng_read_their_ranges_only(tmp_path, monkeypatch):
    raw, _ = many_sections(6000)
    (tmp_path / "a.pcapng").write_bytes(raw)
    read = []
    plain = captures.Cursor.take

    def take(self, offset, size):
        read.append((offset, offset + size))
        return plain(self, offset, size)

    monkeypatch.setattr(captures.Cursor, "take", take)
    monkeypatch.setattr(captures, "MAX_BLOCK", 8192)
    size = 100_000
    probed = []
    for k in range(-(-len(raw) // size)):
        read.clear()
        probed += captures._probe(str(tmp_path / "a.pcapng"), k, size)
        own = [r for r in read if r[0] > 4]
        assert min(r[0] for r in own) >= k * size - 4 or k == 0
        assert max(r[1] for r in own) <= (k + 1) * size + 8192 + 4096
    assert len(probed) > 5 and all(a[5] == b[4] for a, b in zip(probed, probed[1:]))


def test_misleading_blocks_fall_back_to_walking(spark, tmp_path):
    """Payloads that are runs of whole blocks put guesses off, not the result."""
    bait = enhanced("<", 7, b"inside") * 40
    (tmp_path / "a.pcapng").write_bytes(section("<") + interface("<") + b"".join(enhanced("<", i, bait) for i in range(40)))
    assert frames(spark, tmp_path, split_bytes=1500) == [(i, len(bait), bait) for i in range(40)]


def test_pcapng_tail_and_short_blocks(spark, tmp_path):
    raw = section(">") + interface(">", 9) + enhanced(">", 5000, b"abc") + block(">", 6, b"\0" * 8) + enhanced(">", 9000, b"de")
    (tmp_path / "a.pcapng").write_bytes(raw + enhanced(">", 1, b"cut off here")[:30])
    assert frames(spark, tmp_path) == [(5, 3, b"abc"), (9, 2, b"de")]


def test_corrupt_length_reads_no_further_than_the_file(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap([(1, 2, 3, b"abc")]) + struct.pack("<IIII", 9, 9, 2**32 - 1, 2**32 - 1) + b"rest")
    got = read_frames(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(bytes(r["frame"]), r["caplen"]) for r in got] == [(b"abc", 3), (b"rest", 4)]


def test_long_frames_are_hopped_over(spark, tmp_path, monkeypatch):
    recs = [(i, 0, 3_000_000, bytes([i]) * 3_000_000) for i in range(1, 5)]
    (tmp_path / "a.pcap").write_bytes(pcap(recs))
    got = read_frames(spark, str(tmp_path), head=10).orderBy("ord").collect()
    assert [(r["ts_us"], bytes(r["frame"]), r["caplen"]) for r in got] == [(i * 10**6, bytes([i]) * 10, 3_000_000) for i in range(1, 5)]
    assert frames(spark, tmp_path) == expected(recs)


def test_many_small_ranges_share_tasks(spark, tmp_path):
    """A task for each of many small ranges costs more than what they hold."""
    raw, want = many_sections(4000)
    (tmp_path / "a.pcapng").write_bytes(raw)
    assert index_captures(spark, str(tmp_path), 700).count() > 500
    got = read_frames(spark, str(tmp_path), 700, head=None)
    assert got.rdd.getNumPartitions() <= captures.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert [(r["ts_us"], r["wirelen"], bytes(r["frame"])) for r in got.orderBy("ord").collect()] == want


def test_ranges_are_read_about_once(tmp_path, monkeypatch):
    """What is read for small ranges follows their size, not that of a guess's window or a batch."""
    raw, want = many_sections(6000)
    (tmp_path / "a.pcapng").write_bytes(raw)
    size, read = 10_000, []
    plain = captures.Cursor.take

    def take(self, offset, n):
        known = (self.at, len(self.buffer))
        out = plain(self, offset, n)
        if (self.at, len(self.buffer)) != known:
            read.append(len(self.buffer))
        return out

    monkeypatch.setattr(captures.Cursor, "take", take)
    n = -(-len(raw) // size)
    for k in range(n):
        captures._probe(str(tmp_path / "a.pcapng"), k, size)
    assert sum(read) < 4 * len(raw)
    read.clear()
    split = {"file": "a", "kind": "pcapng", "start": 0, "stop": size, "byte_order": "<", "ticks": []}
    with captures.Cursor(str(tmp_path / "a.pcapng"), size) as cur:
        assert sum(b.num_rows for b in captures._frames(cur, split, None)) > 50
    assert sum(read) < 3 * size


def test_guess_looks_as_far_as_the_longest_block(tmp_path):
    """The first run of whole blocks is found wherever it begins, and none behind the last place for a guess."""
    run = b"".join(enhanced(">", i, b"abc") for i in range(captures.PROOF_RECORDS + 1))
    for before in (0, 4, 4 * captures.FIRST_LOOK - 4, 4 * captures.FIRST_LOOK, 4 * captures.FIRST_LOOK + 4, 100_000, captures.MAX_BLOCK + 4, captures.MAX_BLOCK + 8):
        (tmp_path / "a").write_bytes(b"\xff" * before + run + b"\xff" * 8000)
        with captures.Cursor(str(tmp_path / "a"), 4096) as cur:
            assert captures._guess_block(cur, 0) == ((before, ">") if before <= captures.MAX_BLOCK + 4 else (-1, None))

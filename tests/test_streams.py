"""Captures as a format, flows with an idle timeout and windows on streams, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from flowkeel.operators.assembly import packets_to_flows
from flowkeel.operators.normalise import windowed_traffic
from flowkeel.operators.packets import decode_packets
from flowkeel.schema import PACKETS_SCHEMA
from flowkeel.sources import tables
from flowkeel.sources.capture_format import listed, read_captures, register, stream_frames
from flowkeel.sources.captures import read_frames
from flowkeel.sources.flows import write_flows
from flowkeel.streaming.flows import idle_flows
from flowkeel.streaming.runs import append_arrived
from flowkeel.streaming.scoring import stream_flows
from flowkeel.streaming.windows import stream_windowed_traffic
from helpers import make_flows, plan_of, rows_of

SECOND = 1_000_000


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("captures"))
    frames = tables.frames_view(tables.packets_view(spark, sf_dir))
    tables.write_captures(frames, f"{out}/plain")
    tables.write_captures(frames, f"{out}/ng", files=2, ng=True)
    return out


@pytest.mark.parametrize("kind", ["plain", "ng"])
def test_format_reads_what_frames_reads(spark, folder, kind):
    path = f"{folder}/{kind}/*"
    expected = rows_of(read_frames(spark, path, split_bytes=4 << 10))
    by_range = read_captures(spark, path, split_bytes=4 << 10)
    register(spark)
    by_file = spark.read.format("capture").load(path)
    assert rows_of(by_range) == rows_of(by_file) == expected
    files = len(listed(path))
    assert by_file.rdd.getNumPartitions() == files < by_range.rdd.getNumPartitions()
    long = spark.read.format("capture").option("head", "all").load(f"{folder}/{kind}")
    assert long.filter(F.length("frame") == F.col("caplen")).count() == len(expected)


def test_filters_on_files_leave_out_tasks(spark, folder):
    register(spark)
    every = spark.read.format("capture").load(f"{folder}/plain")
    names = [r["file"] for r in every.select("file").distinct().collect()]
    some = every.filter(F.col("file").isin(names[:2]) & (F.col("wirelen") > 100))
    assert some.rdd.getNumPartitions() == 2
    assert rows_of(some) == [r for r in rows_of(every) if r[0] in names[:2] and r[3] > 100]
    assert every.filter(F.col("file") == "none").count() == 0
    assert every.filter(F.col("file") == names[0]).filter(F.col("file") == names[1]).count() == 0


def test_format_names_what_it_cannot_read(spark, tmp_path):
    register(spark)
    (tmp_path / "a.pcap").write_bytes(b"no capture")
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"x")
    assert [f.rpartition("/")[2] for f in listed(str(tmp_path))] == ["a.pcap"]
    with pytest.raises(Exception, match="not a capture file"):
        spark.read.format("capture").load(str(tmp_path)).count()
    with pytest.raises(FileNotFoundError):
        listed(str(tmp_path / "none"))
    with pytest.raises(Exception, match="columns of captures are fixed"):
        spark.read.format("capture").schema("a int").load(str(tmp_path)).count()


def packets(spark, *times, **fields):
    row = {"src_ip": "1.1.1.1", "dst_ip": "2.2.2.2", "sport": 5, "dport": 80, "proto": "TCP", "size": 10, **fields}
    return spark.createDataFrame([(t, *row.values()) for t in times], PACKETS_SCHEMA)


def spans(df):
    return sorted((r["time_us"], r["duration_us"], r["src_packets"] + r["dst_packets"]) for r in df.collect())


def test_a_gap_longer_than_the_timeout_cuts(spark):
    s = SECOND
    df = packets(spark, 0, 10 * s, 20 * s + 1, 20 * s + 2, None)
    assert spans(idle_flows(df, 10)) == [(0, 10 * s, 2), (20 * s + 1, 1, 2)]
    assert spans(idle_flows(df.limit(0), 10)) == []
    with pytest.raises(ValueError):
        idle_flows(df, 0)


def test_without_gaps_flows_are_those_of_the_batch(spark, sf_dir):
    df = tables.packets_view(spark, sf_dir)
    assert rows_of(idle_flows(df, 40 * 86_400)) == rows_of(packets_to_flows(df))
    assert plan_of(idle_flows(df, 60)).count("Exchange hashpartitioning") == 1


def brute_flows(rows, idle):
    """(first time, duration, packets) per conversation cut at silences."""
    by_key = {}
    for t, src, dst, sport, dport, proto, _ in rows:
        by_key.setdefault((frozenset([(src, sport), (dst, dport)]), proto), []).append(t)
    out = []
    for times in by_key.values():
        times.sort()
        cuts = [0, *[i for i in range(1, len(times)) if times[i] - times[i - 1] > idle], len(times)]
        out += [(times[a], times[b - 1] - times[a], b - a) for a, b in zip(cuts, cuts[1:])]
    return sorted(out)


def test_random_packets_against_brute_force(spark):
    rng = random.Random(4)
    ips = [f"10.0.0.{i}" for i in range(4)]
    rows = [(rng.randrange(2_000) * SECOND, rng.choice(ips), rng.choice(ips), rng.choice([80, 5000]), 80, rng.choice(["TCP", "UDP"]), 40)
            for _ in range(400)]
    assert spans(idle_flows(spark.createDataFrame(rows, PACKETS_SCHEMA), 90)) == brute_flows(rows, 90 * SECOND)


def test_stream_ends_flows_as_the_watermark_passes(spark, tmp_path):
    """Three runs over one checkpoint: a flow across two of them, one that is over, one that is still open, and a late packet."""
    s, source = SECOND, str(tmp_path / "in")
    packets(spark, 0).limit(0).write.parquet(source)

    def arrive(*times):
        packets(spark, *times).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PACKETS_SCHEMA).parquet(source)
        append_arrived(idle_flows(stream, 10, delay_sec=5), str(tmp_path / "out"), str(tmp_path / "log"))
        return spans(spark.read.parquet(str(tmp_path / "out")))

    assert arrive(0, 4 * s) == []
    assert arrive(9 * s, 12 * s) == []
    first = [(0, 12 * s, 4)]
    assert arrive(27 * s) == first                  # the watermark, 22 s, reaches the flow's end
    assert arrive(3 * s, 60 * s) == [*first, (27 * s, 0, 1)]  # 3 s is late and dropped


def test_stream_of_captures_gives_the_batch_flows(spark, sf_dir, folder, tmp_path):
    df = tables.packets_view(spark, sf_dir)
    stream = decode_packets(stream_frames(spark, f"{folder}/plain", head=None))
    append_arrived(idle_flows(stream, 3600), str(tmp_path / "out"), str(tmp_path / "log"))
    got, every = rows_of(spark.read.parquet(str(tmp_path / "out"))), rows_of(idle_flows(df, 3600))
    end = df.agg(F.max("ts_us")).first()[0] // 1000 * 1000
    assert got == [r for r in every if r[0] + r[1] + 3600 * SECOND <= end] and 0 < len(got) < len(every)


def test_windows_on_a_stream(spark, tmp_path):
    rng = random.Random(8)
    rows = [dict(time_us=rng.randrange(1_000) * SECOND, src_ip=f"10.0.{rng.randrange(3)}.{rng.randrange(90)}", src_bytes=rng.randrange(50))
            for _ in range(600)]
    rows.sort(key=lambda r: r["time_us"])
    source = str(tmp_path / "in")
    for part in (rows[:300], rows[300:], [dict(time_us=5_000 * SECOND)]):
        write_flows(make_flows(spark, *part).coalesce(1), source, mode="append")
        append_arrived(stream_windowed_traffic(stream_flows(spark, source), delay_sec=60), str(tmp_path / "out"), str(tmp_path / "log"))
    got = {r["window_start"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["window_start"]: r for r in windowed_traffic(make_flows(spark, *rows)).collect()}
    assert got.keys() == want.keys()
    for start, r in want.items():
        assert all(got[start][c] == r[c] for c in ("window_end", "flows", "bytes", "packets", "destinations"))
        assert abs(got[start]["sources"] - r["sources"]) <= max(1, 0.08 * r["sources"])
    late = [dict(time_us=3 * SECOND, src_bytes=9)]
    write_flows(make_flows(spark, *late), source, mode="append")
    append_arrived(stream_windowed_traffic(stream_flows(spark, source), delay_sec=60), str(tmp_path / "out"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)
    with pytest.raises(ValueError):
        stream_windowed_traffic(make_flows(spark, *late), overlap=1.0)


def test_quiet_windows_hold_small_sketches(spark, tmp_path):
    """5,000 windows of a flow each: full sketches would be 3 KB each and are 820 numbers a window in the plan."""
    rows = make_flows(spark, *[dict(time_us=i * 600 * SECOND, src_ip=f"10.0.{i // 256}.{i % 256}") for i in range(5_000)])
    plan = stream_windowed_traffic(rows)._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct" not in plan and "hll_sketch_agg" in plan
    write_flows(rows, str(tmp_path / "in"))
    append_arrived(stream_windowed_traffic(stream_flows(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "log"))
    state = sum(f.stat().st_size for f in (tmp_path / "log" / "state").rglob("*.delta"))
    assert 0 < state < 4_000_000
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.count("*"), F.min("sources"), F.max("destinations")).first()
    assert got[0] > 9_000 and got[1] == 1 and got[2] == 1
    empty = stream_windowed_traffic(make_flows(spark, dict(src_ip=None, dst_ip=None))).agg(F.max("sources"), F.max("destinations")).first()
    assert tuple(empty) == (0, 0)

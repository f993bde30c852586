"""Loading many flow files: names, units, derived columns, order, reports, windows."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowkeel.operators import normalise as norm
from flowkeel.schema import FLOW_COLUMNS, FLOWS_SCHEMA, SPACED, UNDERSCORE, FlowSchema
from flowkeel.sources import flows as io
from flowkeel.sources import tables
from helpers import make_flows, plan_of, rows_of

SPAN_US = 600_000_000
FIRST_US = 1_600_000_000_000_000


def write_part(path, part, n=500):
    """One file of four: its own ten minutes, its own hosts, narrow integer types, times in nanoseconds."""
    k = np.arange(n)
    hosts = [f"192.168.{40 + part}.{v}" for v in range(3, 90)]
    columns = {
        "time_us": pa.array((FIRST_US + part * SPAN_US + k * (SPAN_US // n)) * 1000),
        "duration_us": pa.array(k * k % 90_001 * 1000),
        "src_ip": pa.array([hosts[v % len(hosts)] for v in k * 13]), "src_port": pa.array(20_000 + k % 3_001, pa.int32()),
        "dst_ip": pa.array([f"203.0.113.{v}" for v in k % 31]), "dst_port": pa.array([(22, 123, 8080, 5353)[v] for v in k % 4], pa.int32()),
        "dual": pa.array((k % 5 > 0).astype("int8")), "protocol": pa.array(["UDP" if v % 3 == 0 else "TCP" for v in k]),
        "application": pa.array([("NTP", "SSH", "UNKNOWN")[v] for v in k % 3]),
        "src_packets": pa.array(1 + k % 11, pa.int32()), "dst_packets": pa.array(k % 5 * 2, pa.int32()),
        "src_bytes": pa.array(60 + k * 31 % 4_001), "dst_bytes": pa.array(k % 5 * 512),
    }
    backwards = pa.array(np.flip(k))
    pq.write_table(pa.table({UNDERSCORE.physical(c): v.take(backwards) for c, v in columns.items()}), path)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("parts")
    for i in range(4):
        write_part(d / f"flows-{i}.parquet", i)
    return d


@pytest.fixture(scope="module")
def loaded(spark, folder):
    return norm.normalise(io.read_flows(spark, f"{folder}/*.parquet", UNDERSCORE, "ns", with_file=True), sort=True)


def test_rows_and_types(loaded):
    assert loaded.count() == 2000
    assert [loaded.schema[c].dataType for c in FLOW_COLUMNS] == [FLOWS_SCHEMA[c].dataType for c in FLOW_COLUMNS]


def test_derived_columns(loaded):
    for c in ("time_sec", "datetime", "duration_sec", "src_bpp", "byte_asym"):
        assert c in loaded.columns
    r = loaded.first()
    assert r["duration_sec"] == r["duration_us"] / 1e6
    assert r["src_bpp"] == r["src_bytes"] / max(r["src_packets"], 1)
    assert -1 <= r["byte_asym"] <= 1
    off = loaded.filter(F.unix_micros("datetime") != F.col("time_us")).count()
    assert off == 0


def test_sorted_by_time(loaded):
    times = [r["time_sec"] for r in loaded.select("time_sec").collect()]
    assert times == sorted(times) and len(times) == 2000


def test_no_nulls_in_keys(loaded):
    assert {r["nulls"] for r in norm.null_audit(loaded).collect()} == {0}


def test_nulls_are_found_and_dropped(spark):
    flows = norm.normalise(make_flows(spark, {}, dict(src_ip=None), dict(time_us=None), dict(protocol=None)))
    assert rows_of(norm.null_audit(flows)) == [
        ("dst_ip", 4, 0), ("protocol", 4, 1), ("src_ip", 4, 1), ("time_sec", 4, 1)]
    assert norm.require_keys(flows).count() == 1


def test_file_report(loaded):
    report = io.file_report(loaded).collect()
    assert len(report) == 4 and {r["n_rows"] for r in report} == {500}
    assert all(0 < r["span_sec"] <= 600 for r in report)


@pytest.mark.parametrize("asked, shards, files", [(4, 4, 1), (2, 2, 2), (8, 4, 1)])
def test_shards(spark, folder, loaded, asked, shards, files):
    report = io.shard_report(loaded, io.shard_files(spark, str(folder), asked)).collect()
    assert len(report) == shards and {r["n_files"] for r in report} == {files}
    assert sum(r["n_rows"] for r in report) == 2000


def test_shards_are_loaded_apart(spark, folder):
    parts = io.load_shards(spark, str(folder), 3, UNDERSCORE, "ns")
    assert [own.count() for _, own in parts] == [2, 1, 1] and [f.count() for f, _ in parts] == [1000, 500, 500]
    for flows, own in parts:
        assert rows_of(flows.select("file").distinct()) == rows_of(own)


def test_files_in_parts_count_once(spark, tmp_path):
    """A file of several parts, written without bringing its rows into one task, is one file in reports and shards."""
    flows = make_flows(spark, *[dict(time_us=i * 1_000_000) for i in range(60)]).repartition(5)
    path = str(tmp_path / "load")
    io.write_files(flows, path, F.pmod(F.col("time_us") / 1_000_000, F.lit(3)).cast("int"))
    read = io.read_flows(spark, path, columns=["time_us"], with_file=True)
    assert len(read.inputFiles()) > 3
    assert [tuple(r)[1:] for r in io.file_report(read).orderBy("file").collect()] == [(20, 57.0)] * 3
    report = io.shard_report(read, io.shard_files(spark, path, 2)).orderBy("shard").collect()
    assert [(r["n_files"], r["n_rows"]) for r in report] == [(2, 40), (1, 20)]
    assert sum(f.count() for f, _ in io.load_shards(spark, path, 2)) == 60


def test_schema_roles_from_config():
    s = FlowSchema.from_config({"time_col": "T", "src_ip_col": "S", "dst_ip_col": "D", "protocol_col": "P", "other": 1})
    assert (s.physical("time_us"), s.physical("src_ip"), s.physical("dst_ip"), s.physical("protocol")) == tuple("TSDP")
    assert s.physical("dst_port") == "DST PORT"
    with pytest.raises(ValueError):
        SPACED.renamed(nope="x")


def test_round_trip_with_spaces(spark, tmp_path, flows):
    path = str(tmp_path / "new" / "flows")
    io.write_flows(flows, path)
    raw = spark.read.parquet(path)
    assert raw.columns == ["TIME", "DURATION", "SRC IP", "SRC PORT", "DST IP", "DST PORT", "DUAL", "PROTOCOL",
                           "APPLICATION", "SRC PACKETS", "DST PACKETS", "SRC BYTES", "DST BYTES"]
    assert all(f.endswith(".snappy.parquet") for f in raw.inputFiles())
    assert rows_of(io.read_flows(spark, path)) == rows_of(flows)


@pytest.mark.parametrize("unit, value", [("s", 3), ("ms", 3_000), ("us", 3_000_000), ("ns", 3_000_000_999)])
def test_units(spark, unit, value):
    df = spark.createDataFrame([(value, value)], "TIME bigint, DURATION bigint")
    assert tuple(io.canonical(df, time_unit=unit, columns=["time_us", "duration_us"]).first()) == (3_000_000, 3_000_000)


def test_text_times(spark):
    df = spark.createDataFrame([(" 1 737 700 000 000 001",), ("bad",)], "TIME string")
    lenient = io.canonical(df, strict=False, columns=["time_us"]).collect()
    assert [r[0] for r in lenient] == [1_737_700_000_000_001, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        io.canonical(df, columns=["time_us"]).collect()
    with pytest.raises(ValueError):
        io.canonical(df, time_unit="h")


def test_scan_is_pruned_and_filtered(spark, tmp_path, flows):
    path = str(tmp_path / "flows")
    io.write_flows(flows, path)
    read = io.read_flows(spark, path)
    plan = plan_of(norm.known_applications(read).select("dst_port"))
    assert "ReadSchema: struct<DST PORT:int,APPLICATION:string>" in plan
    assert "Not(EqualTo(APPLICATION,UNKNOWN))" in plan


def brute_windows(rows, window, slide):
    out = {}
    for t, s, d, b, p in rows:
        start = t // slide * slide
        while start > t - window:
            w = out.setdefault(start, [0, 0, 0, set(), set()])
            w[0] += 1
            w[1] += b
            w[2] += p
            w[3].add(s)
            w[4].add(d)
            start -= slide
    return sorted((k, w[0], w[1], w[2], len(w[3]), len(w[4])) for k, w in out.items())


@pytest.mark.parametrize("window, overlap", [(300, 0.5), (300, 0.0), (300, 0.3), (60, 0.75)])
def test_windows(spark, window, overlap):
    rng = np.random.default_rng(9)
    rows = [(int(t), f"s{a}", f"d{b}", int(c), int(d)) for t, a, b, c, d in zip(
        rng.integers(0, 3_000_000_000, 300), rng.integers(0, 9, 300), rng.integers(0, 5, 300),
        rng.integers(0, 99, 300), rng.integers(0, 9, 300))]
    flows = make_flows(spark, *[dict(time_us=t, src_ip=s, dst_ip=d, src_bytes=b, src_packets=p)
                                for t, s, d, b, p in rows], dict(time_us=None))
    got = norm.windowed_traffic(flows, window, overlap).select(F.unix_micros("window_start"), "flows", "bytes",
                                                               "packets", "sources", "destinations")
    slide = round(window * (1 - overlap)) * 1_000_000
    assert rows_of(got) == sorted(brute_windows(rows, window * 1_000_000, slide), key=repr)


def test_windows_agree_with_the_builtin(flows):
    ours = norm.windowed_traffic(flows).select("window_start", "flows", "sources")
    builtin = (flows.groupBy(F.window(F.timestamp_micros("time_us"), "300 seconds", "150 seconds"))
               .agg(F.count("*").alias("flows"), F.count_distinct("src_ip").alias("sources"))
               .select(F.col("window.start").alias("window_start"), "flows", "sources"))
    assert rows_of(ours) == rows_of(builtin)


def test_views_have_the_flow_schema(spark, sf_dir):
    assert [(f.name, f.dataType) for f in tables.flows_view(spark, sf_dir).schema] == [
        (f.name, f.dataType) for f in FLOWS_SCHEMA]

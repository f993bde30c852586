"""Whole jobs: captures to flows, and scoring a stream of flow files."""

import pytest
from pyspark.sql import functions as F

from flowkeel.operators.profile import numeric_profile, rare_values
from flowkeel.params import TrainParams
from flowkeel.plans.capture import capture_flows, capture_job
from flowkeel.plans.training import train_and_flag
from flowkeel.sources import tables
from flowkeel.sources.flows import read_flows, write_flows
from flowkeel.streaming.scoring import score_stream, stream_flows
from helpers import rows_of


@pytest.fixture(scope="module")
def captures(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("captures"))
    tables.write_captures(tables.frames_view(tables.packets_view(spark, sf_dir)), folder, files=3)
    return folder


def test_captures_to_flow_files(spark, sf_dir, captures, tmp_path):
    out = str(tmp_path / "flows")
    capture_job(spark, f"{captures}/*.pcap", out, split_bytes=4096)
    flows = read_flows(spark, out)
    packets = tables.packets_view(spark, sf_dir)
    got = flows.agg(F.sum(F.col("src_packets") + F.col("dst_packets")),
                    F.sum(F.col("src_bytes") + F.col("dst_bytes"))).first()
    assert tuple(got) == tuple(packets.agg(F.count("*"), F.sum("size")).first())


def test_flows_per_capture(spark, captures):
    whole = capture_flows(spark, captures)
    split = capture_flows(spark, captures, per_capture=True)
    assert split.select("file").distinct().count() == 3
    assert split.count() > whole.count()


def test_stream_gives_the_batch_result(spark, flows, tmp_path):
    profile, rare = numeric_profile(flows), rare_values(flows, "src_ip").select("src_ip")
    run = train_and_flag(flows, profile, rare, train=TrainParams(epochs=1))
    threshold = run.summary.first()["threshold"]
    folder = str(tmp_path / "flows")
    write_flows(flows, folder)
    digits = [F.round("recon_error", 9).alias("e"), "is_anomaly", "time_us", "src_ip"]
    for name, kw in (("scored", {}), ("scored_large", {"broadcast_rows": 0})):
        stream = score_stream(stream_flows(spark, folder), run.model, profile, rare, threshold, **kw)
        assert stream.isStreaming
        query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert rows_of(spark.table(name).select(digits)) == rows_of(run.flagged.select(digits))

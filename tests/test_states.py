"""Conversation states of several loads against the packets taken together."""

import random

import pytest
from pyspark.sql import functions as F

from flowkeel.operators.assembly import assemble_flows, flow_states, packets_to_flows
from flowkeel.plans.capture import add_captures, capture_flows, compact_store, stored_flows
from flowkeel.schema import PACKETS_SCHEMA
from flowkeel.sources import tables
from flowkeel.sources.states import read_states, write_load
from helpers import plan_of, rows_of


def packets(spark, n=400, seed=5):
    rng = random.Random(seed)
    ips = [f"10.0.0.{i}" for i in range(4)]
    rows = [(rng.randrange(60), rng.choice(ips), rng.choice(ips), rng.choice([80, 443, 5000]), rng.choice([80, 5001]),
             rng.choice(["TCP", "UDP"]), rng.randrange(40, 1500)) for _ in range(n)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in PACKETS_SCHEMA))


def test_loads_in_any_order_give_the_flows_of_all_packets(spark, tmp_path):
    """Conversations over several loads, equal times, equal addresses."""
    all_packets, store = packets(spark), str(tmp_path / "store")
    for k in (2, 0, 1):
        write_load(flow_states(all_packets.filter(F.col("i") % 3 == k)), store, f"load-{k}")
    expected = rows_of(packets_to_flows(all_packets))
    assert rows_of(stored_flows(spark, store)) == expected
    compact_store(spark, store, str(tmp_path / "new"), "all")
    assert rows_of(stored_flows(spark, str(tmp_path / "new"))) == expected
    assert read_states(spark, str(tmp_path / "new")).count() == len(expected) < read_states(spark, store).count()


def test_repeated_and_empty_loads_count_once(spark, tmp_path):
    one, store = packets(spark, 50), str(tmp_path / "store")
    write_load(flow_states(packets(spark, 30, 9)), store, "a")
    write_load(flow_states(one), store, "a")
    write_load(flow_states(one.limit(0)), store, "b")
    assert rows_of(stored_flows(spark, store)) == rows_of(packets_to_flows(one))
    assert stored_flows(spark, store, loads=["b"]).count() == 0
    with pytest.raises(ValueError):
        write_load(flow_states(one), store, "a/b")


def test_null_fields_keep_their_conversation(spark, tmp_path):
    rows = [(5, None, "9.9.9.9", 1, 2, "TCP", 10), (6, None, "9.9.9.9", 1, 2, "TCP", None), (7, "9.9.9.9", "8.8.8.8", None, 2, None, 4)]
    df, store = spark.createDataFrame(rows, PACKETS_SCHEMA), str(tmp_path / "store")
    for k, row in enumerate(rows):
        write_load(flow_states(spark.createDataFrame([row], PACKETS_SCHEMA)), store, str(k))
    assert rows_of(stored_flows(spark, store)) == rows_of(packets_to_flows(df))


def test_merging_reads_states_only_and_named_loads_only(spark, sf_dir, tmp_path):
    frames, store = tables.frames_view(tables.packets_view(spark, sf_dir)), str(tmp_path / "store")
    folders = [str(tmp_path / f"captures{k}") for k in range(2)]
    for k, folder in enumerate(folders):
        tables.write_captures(frames.filter(F.col("ord") % 2 == k), folder, files=2)
        add_captures(spark, f"{folder}/*.pcap", store, f"l{k}")
    merged = stored_flows(spark, store)
    assert all("/store/load=" in f for f in merged.inputFiles())
    assert rows_of(merged) == rows_of(capture_flows(spark, [f"{f}/*.pcap" for f in folders]))
    named = stored_flows(spark, store, loads=["l1"])
    assert "PartitionFilters: [isnotnull(load" in plan_of(named) or "PartitionFilters: [load" in plan_of(named)
    assert rows_of(named) == rows_of(capture_flows(spark, f"{folders[1]}/*.pcap"))
    assert plan_of(stored_flows(spark, store)).count("Exchange hashpartitioning") == 1 and "Sort" not in plan_of(assemble_flows(packets(spark)))

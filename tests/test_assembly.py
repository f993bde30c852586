"""Flow assembly: hand-built cases, properties and a literal window form."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowkeel.operators.assembly import assemble_flows, label_application, orient, packets_to_flows
from flowkeel.schema import FLOW_COLUMNS, PACKETS_SCHEMA
from helpers import plan_of, rows_of


def packets(spark, *rows):
    return spark.createDataFrame(list(rows), PACKETS_SCHEMA)


def one(spark, *rows):
    out = packets_to_flows(packets(spark, *rows)).collect()
    assert len(out) == 1
    return out[0].asDict()


A, B = "10.0.0.2", "9.9.9.9"


def test_one_way(spark):
    f = one(spark, (5, A, B, 1000, 2000, "TCP", 40), (9, A, B, 1000, 2000, "TCP", 60))
    assert f == dict(time_us=5, duration_us=4, src_ip=A, src_port=1000, dst_ip=B, dst_port=2000, dual=0,
                     protocol="TCP", application="UNKNOWN", src_packets=2, dst_packets=0, src_bytes=100, dst_bytes=0)


def test_initiator_is_earliest_even_if_larger(spark):
    """B is larger as text and sends first."""
    f = one(spark, (7, A, B, 1000, 80, "TCP", 40), (3, B, A, 80, 1000, "TCP", 500), (8, A, B, 1000, 80, "TCP", 41))
    assert (f["src_ip"], f["src_port"], f["dst_ip"], f["dst_port"]) == (B, 80, A, 1000)
    assert (f["src_packets"], f["dst_packets"], f["src_bytes"], f["dst_bytes"]) == (1, 2, 500, 81)
    assert (f["dual"], f["time_us"], f["duration_us"], f["application"]) == (1, 3, 5, "HTTP")


def test_addresses_compare_as_text(spark):
    key = orient(packets(spark, (1, B, A, 1, 2, "TCP", 1))).first()
    assert (key["ip_a"], key["ip_b"], key["fwd"]) == (A, B, False)


def test_tie_goes_to_the_key_order(spark):
    f = one(spark, (3, B, A, 2, 1, "TCP", 10), (3, A, B, 1, 2, "TCP", 20))
    assert (f["src_ip"], f["src_bytes"], f["dst_bytes"]) == (A, 20, 10)


def test_same_address_is_all_source(spark):
    f = one(spark, (4, A, A, 9, 5, "UDP", 10), (6, A, A, 5, 9, "UDP", 20))
    assert (f["src_port"], f["dst_port"], f["src_packets"], f["dst_packets"]) == (9, 5, 2, 0)
    assert (f["src_bytes"], f["dst_bytes"], f["dual"]) == (30, 0, 0)


def test_protocol_separates_flows(spark):
    out = packets_to_flows(packets(spark, (1, A, B, 1, 2, "TCP", 1), (1, A, B, 1, 2, "UDP", 1)))
    assert {r["protocol"] for r in out.collect()} == {"TCP", "UDP"}


def test_single_packet_has_no_duration(spark):
    assert one(spark, (3, A, B, 1, 2, "TCP", 1))["duration_us"] == 0


@pytest.mark.parametrize("src, dst, app", [
    (80, 22, "HTTP"), (50000, 22, "SSH"), (3268, 1, "LDAP"), (389, 443, "LDAP"), (21, 1, "FTP"),
    (1, 443, "SSL"), (50000, 8080, "UNKNOWN")])
def test_labels(spark, src, dst, app):
    df = spark.createDataFrame([(src, dst)], "src_port int, dst_port int")
    assert label_application(df).first()["application"] == app


def test_own_ports(spark):
    df = spark.createDataFrame([(1, 53)], "src_port int, dst_port int")
    assert label_application(df, {53: "DNS"}).first()["application"] == "DNS"


def test_per_capture(spark):
    p = packets(spark, (1, A, B, 1, 2, "TCP", 1), (2, B, A, 2, 1, "TCP", 1)).withColumn(
        "file", F.when(F.col("ts_us") == 1, "x").otherwise("y"))
    assert packets_to_flows(p).count() == 1
    split = packets_to_flows(p, per=("file",))
    assert {(r["file"], r["src_ip"]) for r in split.collect()} == {("x", A), ("y", B)}


@pytest.fixture(scope="module")
def random_packets(spark):
    rng = random.Random(5)
    ips = ["10.0.0.1", "10.0.0.2", "9.9.9.9", "100.1.1.1"]
    rows = [(rng.randrange(2000), rng.choice(ips), rng.choice(ips), rng.randrange(1, 4), rng.randrange(1, 4),
             rng.choice(["TCP", "UDP"]), rng.randrange(40, 1500)) for _ in range(5000)]
    # Half of all packets belong to one conversation.
    rows += [(rng.randrange(2000), *rng.choice([(A, B, 1, 2), (B, A, 2, 1)]), "TCP", 99) for _ in range(5000)]
    return packets(spark, *rows).cache()


def by_windows(p):
    """The same flows, spelled out with first-by-time windows."""
    keys = ["ip_a", "port_a", "ip_b", "port_b", "proto"]
    w = Window.partitionBy(*keys).orderBy("ts_us", F.when(F.col("fwd"), 0).otherwise(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    o = orient(p)
    for c in ("src_ip", "sport", "dst_ip", "dport"):
        o = o.withColumn(f"first_{c}", F.first(c).over(w))
    own = F.col("src_ip") == F.col("first_src_ip")
    g = o.groupBy(*keys).agg(
        F.min("ts_us").alias("time_us"), (F.max("ts_us") - F.min("ts_us")).alias("duration_us"),
        F.first("first_src_ip").alias("src_ip"), F.first("first_sport").alias("src_port"),
        F.first("first_dst_ip").alias("dst_ip"), F.first("first_dport").alias("dst_port"),
        F.count_if(own).alias("src_packets"), F.count_if(~own).alias("dst_packets"),
        F.sum(F.when(own, F.col("size")).otherwise(0)).alias("src_bytes"),
        F.sum(F.when(~own, F.col("size")).otherwise(0)).alias("dst_bytes"))
    g = g.withColumn("dual", F.when((F.col("src_packets") > 0) & (F.col("dst_packets") > 0), 1).otherwise(0))
    return g.withColumnRenamed("proto", "protocol")


def test_equals_window_form(random_packets):
    cols = [c for c in FLOW_COLUMNS if c != "application"]
    assert rows_of(assemble_flows(random_packets).select(cols)) == rows_of(by_windows(random_packets).select(cols))


def test_conserves_packets_and_bytes(random_packets):
    f = assemble_flows(random_packets).agg(
        F.sum(F.col("src_packets") + F.col("dst_packets")), F.sum(F.col("src_bytes") + F.col("dst_bytes"))).first()
    p = random_packets.agg(F.count("*"), F.sum("size")).first()
    assert tuple(f) == tuple(p)


def test_reversed_packets_share_keys(random_packets):
    back = random_packets.select("ts_us", F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"),
                                 F.col("dport").alias("sport"), F.col("sport").alias("dport"), "proto", "size")
    keys = ["ip_a", "port_a", "ip_b", "port_b"]
    assert rows_of(orient(random_packets).select(keys)) == rows_of(orient(back).select(keys))


def test_partitioning_does_not_matter(random_packets):
    want = rows_of(packets_to_flows(random_packets))
    for n in (1, 4, 16):
        assert rows_of(packets_to_flows(random_packets.repartition(n))) == want


def test_one_exchange_and_no_sort(spark):
    plan = plan_of(assemble_flows(packets(spark, (1, A, B, 1, 2, "TCP", 1))))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Sort" not in plan and "HashAggregate" in plan and "ObjectHashAggregate" not in plan

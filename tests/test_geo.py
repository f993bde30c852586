"""As-of interval join against brute force, both ways it can run."""

import random

import pytest
from pyspark.sql import functions as F

from flowkeel.functions.net import int_to_ip, ip_to_int
from flowkeel.operators import geo
from helpers import make_flows, plan_of, rows_of

WAYS = pytest.mark.parametrize("broadcast_rows", [1000, 0], ids=["lookup", "sweep"])


def ranges(spark, rows):
    return spark.createDataFrame(rows, "start_ip_num bigint, end_ip_num bigint, country_name string")


def brute_force(keys, rows):
    out = []
    for k in keys:
        below = [r for r in rows if r[0] <= k]
        if below:
            start = max(r[0] for r in below)
            best = max((r for r in below if r[0] == start), key=lambda r: (r[1], r[2] or ""))
            if k <= best[1]:
                out.append((k, best[2]))
    return sorted(out, key=repr)


def joined(spark, keys, rows, **kw):
    left = spark.createDataFrame([(k,) for k in keys], "num bigint")
    return geo.asof_interval_join(left, ranges(spark, rows), "num", **kw).select("num", "country_name")


@WAYS
@pytest.mark.parametrize("seed", range(3))
def test_random_overlapping_ranges(spark, seed, broadcast_rows):
    rng = random.Random(seed)
    top = [1 << 20, 1 << 26, 1 << 32][seed]
    rows = []
    for i in range(200):
        start = rng.randrange(top)
        rows.append((start, min(start + rng.randrange(1, top // 20), (1 << 32) - 1), f"C{i % 40}"))
    rows += [(rows[0][0], rows[0][1] + 5, "LONGER"), (rows[1][0], rows[1][1], "ZZ")]
    keys = sorted({rng.randrange(top) for _ in range(1500)} | {r[0] for r in rows} | {r[1] for r in rows})
    got = rows_of(joined(spark, keys, rows, broadcast_rows=broadcast_rows))
    assert got == brute_force(keys, rows)


@WAYS
def test_edges(spark, broadcast_rows):
    rows = [(100, 200, "A"), (150, 160, "NEARER"), (300, 300, "ONE"), (1 << 31, (1 << 32) - 1, "TOP"), (400, 410, None)]
    keys = [99, 100, 149, 155, 161, 200, 300, 301, 405, (1 << 31) - 1, 1 << 31, (1 << 32) - 1]
    got = dict(rows_of(joined(spark, keys, rows, broadcast_rows=broadcast_rows)))
    # 161 and 200 lie in A, but the nearer start has already ended.
    assert got == {100: "A", 149: "A", 155: "NEARER", 300: "ONE", 405: None, 1 << 31: "TOP", (1 << 32) - 1: "TOP"}


def test_text_to_number(spark):
    texts = ["0.0.0.1", "255.255.255.255", "172.16.0.0", "1.2.3.256", "a.b.c.d", "1.2.3.4.5", "", " 1.2.3.4", "1.2.3.4x", "0x", "08.1.1.1",
             "1..2", "256.1", "1.2.65536", "4294967296", "-1.2.3.4", "9" * 40, "0x" + "F" * 40, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", ip_to_int(F.col("t"))).orderBy("i").collect()]
    assert got == [1, (1 << 32) - 1, 2886729728] + [0] * (len(texts) - 3)
    back = spark.range(1).select(int_to_ip(F.lit((1 << 32) - 1)), int_to_ip(F.lit(2886729728))).first()
    assert tuple(back) == ("255.255.255.255", "172.16.0.0")


def test_other_forms_of_addresses(spark):
    forms = {"127.1": 2130706433, "010.1.1.1": 134283521, "0x7f.0.0.1": 2130706433, "1.2.3.4 x": 16909060, "1.2.3": 16908291, "1": 1,
             "1.2.65535": 16973823, "0377.1": 4278190081, "4294967295": 4294967295, "0xffffffff": 4294967295, "1.2.3.4\n": 16909060, "00": 0}
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    assert {r[0]: r[1] for r in df.select("t", ip_to_int(F.col("t"))).collect()} == forms


@WAYS
def test_countries(spark, broadcast_rows):
    g = ranges(spark, [(0, 0, "ZERO"), (16909060, 16909060, "B"), (16909061, 16909070, "A"), (16909080, 16909090, None),
                       (16909091, 16909099, "-")])
    flows = make_flows(spark, *[dict(dst_ip=ip) for ip in (
        "1.2.3.4", "1.2.3.4", "1.2.3.5", "1.2.3.6", "bad", "worse", "1.2.3.30", "1.2.3.40", None)])
    top = geo.top_countries(flows, g, 3, broadcast_rows=broadcast_rows).collect()
    # Two bad texts and the null count as address 0; ties go by name; the unnamed range does not count.
    assert [tuple(r) for r in top] == [("ZERO", 3), ("A", 2), ("B", 2)]
    everything = geo.country_counts(flows, g, broadcast_rows=broadcast_rows)
    assert ("-", 1) in rows_of(everything) and everything.count() == 4


def test_no_nested_loops(spark):
    left = spark.range(10).withColumnRenamed("id", "num")
    g = ranges(spark, [(1, 2, "A")])
    lookup = plan_of(geo.asof_interval_join(left, g, "num"))
    sweep = plan_of(geo.asof_interval_join(left, g, "num", broadcast_rows=0))
    for plan in (lookup, sweep):
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "BroadcastHashJoin" in lookup

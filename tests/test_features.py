"""Feature slots on edge values, and the lookup join behind the rare flag."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from flowkeel.operators import features
from flowkeel.operators.lookup import fits_broadcast, hot_keys, lookup_join
from flowkeel.operators.profile import rare_values
from flowkeel.params import FeatureParams
from helpers import make_flows, plan_of, rows_of


def profile_of(spark, **stats):
    names = {"duration": "DURATION", "src_bytes": "SRC BYTES", "dst_bytes": "DST BYTES"}
    rows = [(n, *stats.get(k, (0.0, 1.0))) for k, n in names.items()]
    return spark.createDataFrame(rows, "metric string, median double, iqr double")


def rare_of(spark, *ips):
    return spark.createDataFrame([(ip,) for ip in ips], "src_ip string")


def vectors(spark, flows, params=FeatureParams(), rare=(), **stats):
    df = features.build_features(flows, profile_of(spark, **stats), rare_of(spark, *rare), params)
    return [r["features"] for r in df.orderBy("time_us").collect()]


def test_whole_vector(spark):
    flows = make_flows(spark, dict(duration_us=2_000_000, src_bytes=300, dst_bytes=50, src_packets=3, dst_packets=1,
                                   protocol="udp", src_ip="r"))
    got = vectors(spark, flows, rare=["r"], duration=(1.0, 2.0), src_bytes=(100.0, 100.0), dst_bytes=(100.0, 25.0))
    assert got == [[pytest.approx(v) for v in (
        math.log1p(2), math.log1p(300), math.log1p(50), math.log1p(3), math.log1p(1),
        0.5, 2.0, -2.0, 1.0, 0.0, 1.0, 0.0)]]
    assert len(features.feature_names(FeatureParams())) == 12


def test_clips_and_zero_spread(spark):
    flows = make_flows(spark, dict(time_us=1, src_bytes=10_000, dst_bytes=-10_000, duration_us=-5))
    params = FeatureParams.only("use_raw_duration", "use_raw_dst_bytes", "use_robust_duration", "use_robust_src_bytes",
                                "use_robust_dst_bytes")
    got = vectors(spark, flows, params, duration=(5.0, 0.0), src_bytes=(0.0, 1.0), dst_bytes=(0.0, 1.0))
    assert got == [[0.0, 0.0, 0.0, 10.0, -10.0]]
    tiny = vectors(spark, flows, FeatureParams.only("use_robust_src_bytes"), src_bytes=(0.0, 1e-13))
    assert tiny == [[0.0]]


@pytest.mark.parametrize("protocol, slots", [
    ("TCP", [1, 0, 0]), ("tcp", [1, 0, 0]), ("Udp", [0, 1, 0]), ("ICMP", [0, 0, 1]), (None, [0, 0, 1]), ("", [0, 0, 1])])
def test_protocol_slots(spark, protocol, slots):
    assert vectors(spark, make_flows(spark, dict(protocol=protocol)),
                   FeatureParams.only("use_protocol_encoding")) == [slots]


def test_toggles(spark):
    flows = make_flows(spark, {})
    for name in ("use_raw_duration", "use_robust_src_bytes", "use_rare_src_ip"):
        assert len(vectors(spark, flows, FeatureParams.only(name))[0]) == 1
    assert FeatureParams.from_config({}) == FeatureParams.only()
    with pytest.raises(ValueError):
        features.build_features(flows, None, None, FeatureParams.only())
    with pytest.raises(ValueError):
        FeatureParams(duration_units="hours")


def test_legacy_duration_is_microseconds(spark):
    flows = make_flows(spark, dict(duration_us=3_000_000))
    params = FeatureParams.only("use_raw_duration", "use_robust_duration", duration_units="legacy")
    assert vectors(spark, flows, params, duration=(1.0, 2.0)) == [[pytest.approx(math.log1p(3e6)), 10.0]]


def test_missing_volume_fails(spark):
    with pytest.raises(Exception, match="null in src_bytes"):
        vectors(spark, make_flows(spark, dict(src_bytes=None)))


def test_sanity_covers_all_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([-3.0, 10.0],)], "features array<double>")
    assert tuple(features.feature_sanity(df).first()) == (2, 2, -3.0, 10.0, 2.5)
    assert features.feature_sanity(df.limit(0)).first()["mean"] is None


def test_both_lookups_agree(spark, flows):
    rare = rare_values(flows, "src_ip").select("src_ip").cache()
    small = features.rare_feature(flows, rare)
    large = features.rare_feature(flows, rare, broadcast_rows=0)
    assert rows_of(small) == rows_of(large)
    assert "BroadcastHashJoin" in plan_of(small)
    assert small.filter("rare_src_ip = 1").count() == flows.join(rare, "src_ip").count()


def test_large_lookup_keeps_hot_keys_out_of_the_shuffle(spark):
    facts = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
            F.col("id").cast("string")).alias("k"), "id")
    dim = spark.createDataFrame([("hot", 1), ("8", 2), ("unused", 3)], "k string, v int")
    assert hot_keys(facts, "k") == ["hot"]
    want = rows_of(lookup_join(facts, dim, "k"))
    large = lookup_join(facts, dim, "k", broadcast_rows=0)
    assert rows_of(large) == want and large.count() == 20_000
    assert large.filter("v = 1").count() == 6667 and large.filter("v = 2").count() == 1
    none_hot = lookup_join(facts, dim, "k", broadcast_rows=0, share=1.0)
    assert rows_of(none_hot) == want


def test_broadcast_is_size_checked(spark):
    assert fits_broadcast(spark.range(10), 10) and not fits_broadcast(spark.range(11), 10)


def test_no_computed_column_is_shuffled_with_the_lookup(spark):
    """The vectors' numbers come from columns that are there already, behind the join."""
    flows = make_flows(spark, *[dict(src_ip=f"10.0.0.{i}", src_bytes=i) for i in range(20)])
    rare = spark.createDataFrame([("10.0.0.3", 1)], "src_ip string, n bigint")
    profile = spark.createDataFrame([(m, 1.0, 2.0) for m in features.ROBUST.values()], "metric string, median double, iqr double")
    out = features.build_features(flows, profile, rare, broadcast_rows=0, share=1.0)
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(lines) if "Join LeftOuter" in line]
    assert joins
    for i in joins:
        depth = lines[i].index("Join")
        below = itertools.takewhile(lambda line: len(line) - len(line.lstrip(" :+-")) > depth, lines[i + 1:])
        assert not any("raw_src_bytes" in line or "robust_src_bytes" in line for line in below)
    got = {r["src_bytes"]: r["features"][features.feature_names(FeatureParams()).index("rare_src_ip")] for r in out.collect()}
    assert got == {i: float(i == 3) for i in range(20)}
    marked = features.rare_feature(flows, rare)
    assert rows_of(features.build_features(marked, profile, None).select(*out.columns)) == rows_of(out)

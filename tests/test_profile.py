"""Profile operators on edge cases and against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkeel.operators import profile
from flowkeel.operators.normalise import known_applications
from flowkeel.operators.quantiles import approx_stats, exact_stats, from_key, order_key
from helpers import make_flows, plan_of, rows_of

PROBS = [0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1.0]


def check_quantiles(spark, columns):
    rows = list(zip(*[[int(v) for v in c] for c in columns.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in columns)).repartition(5)
    got = exact_stats(df, {n: F.col(n) for n in columns}, PROBS)
    for n, values in columns.items():
        want = np.quantile(np.array(values, dtype="float64"), PROBS)
        assert np.allclose([got[n].quantiles[p] for p in PROBS], want, rtol=1e-12, atol=1e-9)
        assert (got[n].n, got[n].min, got[n].max) == (len(values), min(values), max(values))
        assert math.isclose(got[n].mean, np.mean(values), rel_tol=1e-12, abs_tol=1e-9)
        assert math.isclose(got[n].stddev, np.std(values), rel_tol=1e-9, abs_tol=1e-9)


def test_exact_quantiles_of_many_shapes(spark):
    rng = np.random.default_rng(3)
    n = 3001
    hot = rng.integers(0, 10**9, n)
    hot[: n // 2] = 123_456_789
    check_quantiles(spark, {
        "small": rng.integers(0, 50, n),
        "heavy_tail": (rng.pareto(0.5, n) * 1000).clip(0, 1e15).astype("int64"),
        "huge": rng.integers(2**50, 2**51, n),
        "signed": rng.integers(-10**7, 10**7, n),
        "constant": np.full(n, 77),
        "hot": hot,
    })


def test_exact_quantiles_of_few_rows(spark):
    check_quantiles(spark, {"x": [5]})
    check_quantiles(spark, {"x": [10**12, 10**12 + 3]})


def test_quantiles_skip_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, None)], "a bigint, b bigint")
    got = exact_stats(df, {"a": F.col("a"), "b": F.col("b")}, [0.5])
    assert got["a"].quantiles[0.5] == 2.0 and got["a"].n == 2 and "b" not in got


def test_approximation_is_close(spark):
    df = spark.range(10_001)
    assert abs(approx_stats(df, {"x": F.col("id")}, [0.5])["x"].quantiles[0.5] - 5000) <= 2


def test_numeric_profile_of_nothing(spark):
    rows = profile.numeric_profile(make_flows(spark, {}).limit(0)).collect()
    assert len(rows) == 5 and all(v is None for r in rows for v in list(r)[1:])


def test_global_summary_edges(spark):
    def span(*times):
        r = profile.global_summary(make_flows(spark, *[dict(time_us=t) for t in times])).first()
        return r["file_timespan_seconds"]

    assert span(1_000_000, 4_000_000) == 3.0
    assert span(2_000_000, 2_000_000) == 1.0
    assert span(0, 5_000_000) == 1.0
    empty = profile.global_summary(make_flows(spark, {}).limit(0)).first()
    assert tuple(empty) == (0, 1.0, 0, 0, 0.0, 0.0)


def test_ratios_are_whole(spark):
    flows = make_flows(spark, dict(src_bytes=7, dst_bytes=1, src_packets=3), dict(src_bytes=9, dst_bytes=0))
    got = {r["metric"]: r["median"] for r in profile.ratio_profile(flows).collect()}
    assert got == {"SRC_TO_DST_BYTES_ASYMMETRY": (3 + 9) / 2, "SRC_AVG_PACKET_SIZE": (1 + 4) / 2}


def test_entropy(spark):
    flows = make_flows(spark, *[dict(src_port=p, application=a) for p, a in (
        (1, "A"), (2, "A"), (3, "B"), (None, "UNKNOWN"), (None, None))])
    got = {r["column"]: r["entropy"] for r in profile.entropy_profile(flows).collect()}
    # Null is a fourth port, held by two of five flows.
    want = -(3 * 0.2 * math.log2(0.2) + 0.4 * math.log2(0.4))
    assert math.isclose(got["SRC PORT"], want)
    assert got["PROTOCOL"] == 0.0
    assert math.isclose(got["APPLICATION"], -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))
    empty = profile.entropy_profile(flows.limit(0)).collect()
    assert [r["entropy"] for r in empty] == [0.0] * 4


def test_entropy_bounds(flows):
    k = flows.select("src_port").distinct().count()
    got = {r["column"]: r["entropy"] for r in profile.entropy_profile(flows).collect()}
    assert 0 <= got["SRC PORT"] <= math.log2(k) + 1e-9


def test_fan_out_ignores_nulls(spark):
    flows = make_flows(spark, dict(dst_ip="a", dst_port=1), dict(dst_ip="b", dst_port=1), dict(dst_ip=None, dst_port=2),
                       dict(src_ip="other", dst_ip=None, dst_port=None))
    fan = profile.fan_out(flows)
    assert rows_of(fan) == [("10.0.0.1", 2, 2), ("other", 0, 0)]
    assert tuple(profile.fan_out_limits(fan).first()) == (2, pytest.approx(1.9), 2, pytest.approx(1.9))


def test_rare_values(spark):
    flows = make_flows(spark, *[dict(src_ip=ip) for ip in ["a"] * 2 + ["b"] * 3 + ["c"] + [None]])
    assert {(r["src_ip"], r["n"]) for r in profile.rare_values(flows, "src_ip").collect()} == {
        ("a", 2), ("c", 1), (None, 1)}
    assert [r["src_ip"] for r in profile.rare_values(flows, "src_ip", limit=2).collect()] == [None, "c"]


def test_share(spark):
    flows = make_flows(spark, *[dict(protocol=p) for p in ("TCP", "TCP", "UDP", None)])
    assert {(r["protocol"], r["pct"]) for r in profile.share(flows, "protocol").collect()} == {
        ("TCP", 50.0), ("UDP", 25.0), (None, 25.0)}


def test_timeline_matches_numpy(spark):
    times = [1_000_000 * t for t in (10, 11, 12, 13, 40, 41, 99, 100)]
    got = profile.timeline_histogram(make_flows(spark, *[dict(time_us=t) for t in times]), 6).orderBy("bin").collect()
    counts, edges = np.histogram(np.array(times) / 1e6, bins=6)
    assert [r["n"] for r in got] == counts.tolist()
    assert np.allclose([r["bin_start"] for r in got], edges[:-1])


def test_timeline_of_one_instant_matches_numpy(spark):
    got = profile.timeline_histogram(make_flows(spark, {}, {}), 60).orderBy("bin").collect()
    counts, edges = np.histogram(np.array([1.0, 1.0]), bins=60)
    assert [r["n"] for r in got] == counts.tolist()
    assert np.allclose([r["bin_start"] for r in got], edges[:-1])


def test_histogram_totals(spark, flows):
    assert profile.histogram(flows, "src_bytes", 17).agg(F.sum("n")).first()[0] == flows.count()
    as_double = flows.withColumn("x", F.col("src_bytes") / 7.0)
    assert profile.histogram(as_double, "x", 17).agg(F.sum("n")).first()[0] == flows.count()


def test_port_app_limits(spark):
    def pairs(port, app, n):
        return [dict(dst_port=port, application=app)] * n

    flows = make_flows(
        spark, *pairs(1, "FIVE", 5), *pairs(2, "SIX", 6),                 # count must exceed 5
        *pairs(3, "EDGE", 6), *pairs(3, "REST", 14),                      # 6 of 20 is exactly 0.30
        *pairs(4, "BELOW", 6), *pairs(4, "REST", 15),
        *pairs(5, "UNKNOWN", 50), *pairs(5, None, 50), *pairs(5, "KNOWN", 6))
    likely = profile.port_app_probability(flows)
    assert {(r["dst_port"], r["application"]) for r in likely.collect()} == {
        (2, "SIX"), (3, "EDGE"), (3, "REST"), (4, "REST"), (5, "KNOWN")}
    assert profile.port_app_map(likely).first()[0] == {"2": ["SIX"], "3": ["EDGE", "REST"], "4": ["REST"], "5": ["KNOWN"]}
    assert known_applications(flows).filter("dst_port = 5").count() == 6


def test_map_side_combine_everywhere(flows):
    for df in (profile.fan_out(flows), profile.value_counts(flows, "src_ip"), profile.entropy_profile(flows)):
        assert "partial_count" in plan_of(df)


def test_quantiles_of_doubles(spark):
    rng = np.random.default_rng(4)
    special = [0.25, 0.5, 1.75, -3.5, 0.0, -0.0, 1e-310, -5e-324, 1.7e308, -1e300, 2.0 ** -1022, 1.0, 2.0, 0.1]
    for values in ([0.25, 0.5, 1.75], special, rng.normal(size=500).tolist(), (10.0 ** rng.uniform(-300, 300, 200)).tolist()):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
        s = exact_stats(df, {"X": F.col("x")}, [0.0, 0.25, 0.5, 0.9, 1.0])["X"]
        assert (s.n, s.min, s.max) == (len(values), min(values), max(values))
        with np.errstate(over="ignore", invalid="ignore"):
            assert np.isclose(s.mean, np.mean(values)) or not np.isfinite(np.mean(values))
            for p, q in s.quantiles.items():
                want = np.quantile(values, p)
                assert np.isclose(q, want, rtol=1e-12, atol=0) or not np.isfinite(want)


def test_double_keys_ascend(spark):
    values = sorted([float("-inf"), -1e308, -1.5, -5e-324, 0.0, 5e-324, 1e-310, 2.0 ** -1022, 0.1, 1.0, 1.0000000000000002, 3e7, float("inf")])
    df = spark.createDataFrame([(v,) for v in values], "x double")
    keys = [r[0] for r in df.select(order_key(F.col("x"))).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(values) and [from_key(k) for k in keys] == values

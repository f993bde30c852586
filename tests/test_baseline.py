"""The baseline document: shape, JSON round trip, NaN guard, and the whole profiling job."""

import json
import os

import pytest
from pyspark.sql import functions as F

from flowkeel.operators import profile
from flowkeel.operators.features import build_features
from flowkeel.plans.baseline import build_baseline, profile_job
from flowkeel.sources import baseline as io
from flowkeel.sources import tables
from flowkeel.sources.geo import read_geo
from helpers import make_flows, rows_of


@pytest.fixture(scope="module")
def geo(spark, sf_dir):
    return tables.geo_view(spark, sf_dir)


@pytest.fixture(scope="module")
def written(spark, flows, geo, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("doc") / "baseline")
    io.write_baseline(build_baseline(flows, geo), path)
    return path


def test_one_json_document(written, flows):
    parts = [f for f in os.listdir(written) if f.endswith(".json")]
    assert len(parts) == 1
    with open(f"{written}/{parts[0]}") as f:
        doc = json.load(f)
    assert list(doc) == ["global_summary", "geo_profile", "numerical_profiles", "ratio_profiles", "global_entropy",
                         "structural_limits", "categorical_baselines"]
    assert doc["global_summary"]["total_records"] == flows.count()
    assert set(doc["numerical_profiles"]) == {"DURATION", "SRC PACKETS", "DST PACKETS", "SRC BYTES", "DST BYTES"}
    assert 0 < len(doc["geo_profile"]["top_countries"]) <= 15
    assert len(doc["categorical_baselines"]["rare_src_ips_sample"]) == min(
        2000, profile.rare_values(flows, "src_ip").count())


def test_read_back(spark, written, flows):
    doc = io.read_baseline(spark, written)
    assert rows_of(io.profile_rows(doc)) == rows_of(profile.numeric_profile(flows))
    vectors = build_features(flows, io.profile_rows(doc), io.rare_sources(doc))
    assert vectors.count() == flows.count()


def test_reads_an_indented_document(spark, tmp_path):
    stats = dict.fromkeys("min max mean stddev p25 median p75 p95 p99 p999 iqr".split(), 1.5)
    doc = {"geo_profile": {"error": "no file"}, "numerical_profiles": {"DURATION": stats},
           "categorical_baselines": {"rare_src_ips_sample": ["1.2.3.4"], "rare_dst_ips_sample": [],
                                     "probabilistic_port_applications": {"80": ["HTTP"]}}}
    path = tmp_path / "b.json"
    path.write_text(json.dumps(doc, indent=4))
    got = io.read_baseline(spark, str(path))
    assert got.count() == 1
    assert rows_of(io.rare_sources(got)) == [("1.2.3.4",)]
    assert io.profile_rows(got).first()["median"] == 1.5
    assert got.first()["geo_profile"]["error"] == "no file"


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_rejects_what_json_cannot_carry(spark, bad, tmp_path):
    doc = spark.range(1).select(
        F.create_map(F.lit("x"), F.struct(F.lit(1.0).alias("a"), F.lit(bad).alias("b"))).alias("numbers"),
        F.array(F.lit("t")).alias("texts"))
    with pytest.raises(Exception, match="numbers holds a value JSON cannot carry"):
        io.write_baseline(doc, str(tmp_path / "x"))
    fine = spark.range(1).select(F.create_map(F.lit("x"), F.struct(F.lit(None).cast("double").alias("b"))).alias("m"))
    assert io.checked(fine).first()["m"]["x"]["b"] is None


def test_without_ranges_the_rest_goes_on(spark, flows):
    doc = build_baseline(flows).first()
    assert doc["geo_profile"]["top_countries"] is None and doc["geo_profile"]["error"]
    assert doc["global_summary"]["total_records"] == flows.count()


def test_sample_is_limited_by_count_then_name(spark):
    from flowkeel.params import ProfileParams

    flows = make_flows(spark, *[dict(src_ip=ip) for ip in ("b", "b", "a", "a", "d", "c")])
    doc = build_baseline(flows, params=ProfileParams(rare_limit=3)).first()
    assert doc["categorical_baselines"]["rare_src_ips_sample"] == ["c", "d", "a"]


def test_profiling_job(spark, flows, geo, tmp_path):
    geo.write.parquet(str(tmp_path / "geo"))
    summary = profile_job(flows, read_geo(spark, str(tmp_path / "geo")), str(tmp_path / "doc"),
                          str(tmp_path / "reports")).first()
    assert summary["flows"] == flows.count()
    charts = {n: spark.read.parquet(str(tmp_path / "reports" / n)) for n in (
        "traffic_over_time", "protocol_distribution", "top_countries")}
    assert charts["traffic_over_time"].count() == 60 and 0 < charts["top_countries"].count() <= 10
    assert abs(charts["protocol_distribution"].agg(F.sum("pct")).first()[0] - 100) < 0.2
    top = charts["top_countries"].orderBy(F.desc("flow_count"), "country_name").first()
    assert (top["country_name"], top["flow_count"]) == (summary["top_country"], summary["top_country_flows"])

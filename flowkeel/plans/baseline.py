"""Profiling job: flow files and address ranges to the baseline document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkeel.operators import geo as geo_ops
from flowkeel.operators import profile as prof
from flowkeel.params import ProfileParams
from flowkeel.schema import BASELINE_DDL
from flowkeel.session import materialise
from flowkeel.sources.baseline import write_baseline, write_rare


def _map(rows: DataFrame, key: str, value: Column) -> Column:
    """All `rows` as one map; for tables of bounded size."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))))
    return rows.agg(F.map_from_entries(entries).alias("m")).scalar()


def _list(rows: DataFrame, column: str) -> Column:
    """A limited sample as one array, ordered by (count, value)."""
    entries = F.array_sort(F.collect_list(F.struct("n", column)))
    return rows.agg(F.transform(entries, lambda e: e[column]).alias("a")).scalar()


def build_baseline(flows: DataFrame, geo: DataFrame | str | None = None, params: ProfileParams = ProfileParams(),
                   approx: bool = False) -> DataFrame:
    """The baseline document as one nested row.

    Quantiles take a few passes of their own; the other sections are scalar
    subqueries of one query and run side by side. `flows` is scanned several times, a
    few columns each, so it should be a table rather than the result of a join.
    Without `geo` the country block says why it is empty; text in its place is the reason
    (see `flowkeel.sources.geo.try_read_geo`).
    """
    stats = ["min", "max", "mean", "stddev", "p25", "median", "p75", "p95", "p99", "p999", "iqr"]
    none = F.lit(None)
    if not isinstance(geo, DataFrame):
        geo_block = F.struct(none.cast("map<string,bigint>").alias("top_countries"),
                             F.lit(geo or "no address ranges given").alias("error"))
    else:
        top = geo_ops.top_countries(flows, geo, params.top_countries)
        geo_block = F.struct(_map(top, "country_name", F.col("flow_count")).alias("top_countries"),
                             none.cast("string").alias("error"))
    likely = prof.port_app_probability(flows, params.min_probability, params.min_pair_count)
    limits = ["max_unique_dst_ips_per_src", "p95_unique_dst_ips_per_src",
              "max_unique_dst_ports_per_src", "p95_unique_dst_ports_per_src"]

    numeric, ratios = prof.distribution_profiles(flows, approx)
    fan = materialise(prof.fan_out(flows, approx=approx), "fan-out")

    def rare(column: str) -> Column:
        return _list(prof.rare_values(flows, column, params.rare_threshold, params.rare_limit), column)

    sections = {
        "global_summary": prof.global_summary(flows).select(F.struct("*")).scalar(),
        "geo_profile": geo_block,
        "numerical_profiles": _map(numeric, "metric", F.struct(*stats)),
        "ratio_profiles": _map(ratios, "metric", F.struct("median", "p95", "p99")),
        "global_entropy": _map(prof.entropy_profile(flows), "column", F.col("entropy")),
        "structural_limits": prof.fan_out_limits(fan).select(F.struct(*limits)).scalar(),
        "categorical_baselines": F.struct(
            rare("src_ip").alias("rare_src_ips_sample"),
            rare("dst_ip").alias("rare_dst_ips_sample"),
            prof.port_app_map(likely).scalar().alias("probabilistic_port_applications")),
    }
    types = {f.name: f.dataType for f in flows.sparkSession.createDataFrame([], BASELINE_DDL).schema}
    return flows.sparkSession.range(1).select(
        *[col.cast(types[name]).alias(name) for name, col in sections.items()])


def profile_run_summary(flows: DataFrame, geo: DataFrame | str | None = None) -> DataFrame:
    """One row: flows, time span, volume in MB (1024^2) and the top country."""
    out = prof.global_summary(flows).select(
        F.col("total_records").alias("flows"), F.col("file_timespan_seconds").alias("timespan_sec"),
        (F.col("total_bytes_transferred") / F.lit(1024.0 * 1024.0)).alias("payload_mb"))
    if not isinstance(geo, DataFrame):
        return out
    top = geo_ops.top_countries(flows, geo, 1).select(F.struct(
        F.col("country_name").alias("top_country"), F.col("flow_count").alias("top_country_flows"))).scalar()
    return out.withColumn("_top", top).select("flows", "timespan_sec", "payload_mb", "_top.*")


def chart_tables(flows: DataFrame, geo: DataFrame | str | None = None,
                 params: ProfileParams = ProfileParams()) -> dict[str, DataFrame]:
    """The data behind the three report charts."""
    tables = {
        "traffic_over_time": prof.timeline_histogram(flows, params.timeline_bins),
        "protocol_distribution": prof.share(flows, "protocol").withColumn("pct", F.round("pct", 1)),
    }
    if isinstance(geo, DataFrame):
        tables["top_countries"] = geo_ops.top_countries(flows, geo, params.chart_countries)
    return tables


def profile_job(flows: DataFrame, geo: DataFrame | str | None, baseline_path: str, report_dir: str,
                params: ProfileParams = ProfileParams(), approx: bool = False) -> DataFrame:
    """Writes the baseline document, the full set of rare sources beside it, and the chart tables.

    Returns the run summary. The document holds a sample of the rare sources; training and
    streams read the full set (`flowkeel.sources.baseline.read_rare`).
    """
    write_baseline(build_baseline(flows, geo, params, approx), baseline_path)
    write_rare(prof.rare_values(flows, "src_ip", params.rare_threshold), baseline_path)
    for name, rows in chart_tables(flows, geo, params).items():
        rows.write.mode("overwrite").parquet(f"{report_dir}/{name}")
    return profile_run_summary(flows, geo)

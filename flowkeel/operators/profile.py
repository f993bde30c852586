"""Aggregates that describe a flow table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowkeel.operators.normalise import known_applications
from flowkeel.operators.quantiles import Stats, approx_stats, exact_stats
from flowkeel.params import ProfileParams

# Metric name in the baseline document -> (integer input, divisor to the reported unit).
NUMERIC_METRICS = {
    "DURATION": ("duration_us", 1e6),
    "SRC PACKETS": ("src_packets", 1.0),
    "DST PACKETS": ("dst_packets", 1.0),
    "SRC BYTES": ("src_bytes", 1.0),
    "DST BYTES": ("dst_bytes", 1.0),
}
QUANTILE_NAMES = {0.25: "p25", 0.50: "median", 0.75: "p75", 0.95: "p95", 0.99: "p99", 0.999: "p999"}
ENTROPY_COLUMNS = {
    "SRC PORT": "src_port",
    "DST PORT": "dst_port",
    "PROTOCOL": "protocol",
    "APPLICATION": "application",
}
# Whole-number ratios: integer division, as on integer columns of the original.
RATIO_METRICS = {
    "SRC_TO_DST_BYTES_ASYMMETRY": "src_bytes div (dst_bytes + 1)",
    "SRC_AVG_PACKET_SIZE": "src_bytes div (src_packets + 1)",
}


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null is a value."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def global_summary(flows: DataFrame) -> DataFrame:
    """One row of totals and rates.

    The time span is 1.0 where a bound is missing or zero, or both are equal.
    """
    def total(*columns: str) -> Column:
        parts = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")) for c in columns]
        return parts[0] + parts[1]

    lo, hi = F.col("_min"), F.col("_max")
    span = F.when((lo != 0) & (hi != 0) & (hi > lo), hi / 1e6 - lo / 1e6).otherwise(F.lit(1.0))
    return (
        flows.agg(
            F.count("*").alias("total_records"),
            F.min("time_us").alias("_min"), F.max("time_us").alias("_max"),
            total("src_bytes", "dst_bytes").alias("total_bytes_transferred"),
            total("src_packets", "dst_packets").alias("total_packets_transferred"),
        )
        .withColumn("file_timespan_seconds", span)
        .select(
            "total_records", "file_timespan_seconds",
            "total_bytes_transferred", "total_packets_transferred",
            (F.col("total_bytes_transferred") / F.col("file_timespan_seconds"))
            .alias("file_avg_bytes_per_sec"),
            (F.col("total_packets_transferred") / F.col("file_timespan_seconds"))
            .alias("file_avg_packets_per_sec"),
        )
    )


RATIO_QUANTILES = {0.50: "median", 0.95: "p95", 0.99: "p99"}


def _numeric_rows(spark: SparkSession, stats: dict[str, Stats], metrics: dict[str, tuple[str, float]],
                  quantiles: dict[float, str] = QUANTILE_NAMES) -> DataFrame:
    rows = []
    for metric, (_, scale) in metrics.items():
        s = stats.get(metric)
        values = [None] * (4 + len(quantiles)) if s is None else [
            v / scale for v in (s.min, s.max, s.mean, s.stddev, *(s.quantiles[p] for p in quantiles))]
        middle = None if s is None else s.quantiles[0.75] / scale - s.quantiles[0.25] / scale
        rows.append((metric, *values, middle))
    names = ("min", "max", "mean", "stddev", *quantiles.values(), "iqr")
    return spark.createDataFrame(rows, "metric string, " + ", ".join(f"{n} double" for n in names))


def _ratio_rows(spark: SparkSession, stats: dict[str, Stats]) -> DataFrame:
    rows = [(m, *[stats[m].quantiles[p] if m in stats else None for p in RATIO_QUANTILES]) for m in RATIO_METRICS]
    return spark.createDataFrame(
        rows, "metric string, " + ", ".join(f"{n} double" for n in RATIO_QUANTILES.values()))


def _numeric_columns(metrics: dict[str, tuple[str, float]]) -> dict[str, Column]:
    return {m: F.col(c) for m, (c, _) in metrics.items()}


def _ratio_columns() -> dict[str, Column]:
    return {m: F.expr(e) for m, e in RATIO_METRICS.items()}


def numeric_profile(flows: DataFrame, metrics: dict[str, tuple[str, float]] = NUMERIC_METRICS,
                    approx: bool = False, quantiles: dict[float, str] = QUANTILE_NAMES) -> DataFrame:
    """Moments and quantiles, one row per metric; the deviation is the population's.

    `quantiles` maps probabilities to column names; the spread between the quarters comes with any.
    """
    measure = approx_stats if approx else exact_stats
    stats = measure(flows, _numeric_columns(metrics), sorted({*quantiles, 0.25, 0.75}))
    return _numeric_rows(flows.sparkSession, stats, metrics, quantiles)


def ratio_profile(flows: DataFrame, approx: bool = False) -> DataFrame:
    """Quantiles of source bytes per destination byte and per source packet."""
    measure = approx_stats if approx else exact_stats
    return _ratio_rows(flows.sparkSession, measure(flows, _ratio_columns(), list(RATIO_QUANTILES)))


def distribution_profiles(flows: DataFrame, approx: bool = False) -> tuple[DataFrame, DataFrame]:
    """`numeric_profile` and `ratio_profile` from the same passes."""
    measure = approx_stats if approx else exact_stats
    stats = measure(flows, _numeric_columns(NUMERIC_METRICS) | _ratio_columns(), list(QUANTILE_NAMES))
    return (_numeric_rows(flows.sparkSession, stats, NUMERIC_METRICS), _ratio_rows(flows.sparkSession, stats))


def _entropy(counts: DataFrame, by: str) -> DataFrame:
    n = F.col("n").cast("double")
    total, weighted = F.sum(n), F.sum(n * F.log2(n))
    return counts.groupBy(by).agg(F.greatest(F.lit(0.0), F.log2(total) - weighted / total).alias("entropy"))


def entropy_profile(flows: DataFrame, columns: dict[str, str] = ENTROPY_COLUMNS) -> DataFrame:
    """Shannon entropy in bits per column; null is a value, no rows give 0.

    Application entropy ignores unlabelled flows. All columns share one shuffle
    of (column, value) counts: H = log2(T) - sum(n * log2(n)) / T.
    """
    stacked = flows.select(*[F.col(c).cast("string").alias(name) for name, c in columns.items()]).unpivot(
        [], list(columns), "column", "value")
    labelled = ~F.col("column").eqNullSafe("APPLICATION") | F.coalesce(F.col("value") != "UNKNOWN", F.lit(False))
    counts = stacked.filter(labelled).groupBy("column", "value").agg(F.count("*").alias("n"))
    names = flows.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(_entropy(counts, "column")), "column", "left").select(
        "column", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def fan_out(flows: DataFrame, key: str = "src_ip",
            targets: Sequence[str] = ("dst_ip", "dst_port"), approx: bool = False) -> DataFrame:
    """Distinct targets per key.

    Distinct counts first reduce (key, target) pairs, which spreads the pairs of
    a busy key over all tasks.
    """
    count = F.approx_count_distinct if approx else F.count_distinct
    return flows.groupBy(key).agg(*[count(F.col(t)).alias(f"unique_{t}s") for t in targets])


def fan_out_limits(fan: DataFrame) -> DataFrame:
    """Maximum and 95th percentile of the per-source counts, in one row."""
    metrics = {"dst_ips": "unique_dst_ips", "dst_ports": "unique_dst_ports"}
    stats = exact_stats(fan, {m: F.col(c) for m, c in metrics.items()}, [0.95])
    row, schema = [], []
    for m in metrics:
        s = stats.get(m)
        row += [None, None] if s is None else [s.max, s.quantiles[0.95]]
        schema += [f"max_unique_{m}_per_src bigint", f"p95_unique_{m}_per_src double"]
    return fan.sparkSession.createDataFrame([tuple(row)], ", ".join(schema))


def rare_values(df: DataFrame, column: str, threshold: int = 3, limit: int | None = None) -> DataFrame:
    """Values seen fewer than `threshold` times, with their counts.

    The whole set by default. `limit` takes the first by (count, value), for the
    sample kept in the baseline document.
    """
    rare = value_counts(df, column).filter(F.col("n") < threshold)
    return rare if limit is None else rare.orderBy("n", column).limit(limit)


def share(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage of all rows per value."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def histogram(df: DataFrame, column: str, bins: int = 60, margin: float = 0.5) -> DataFrame:
    """Equal-width counts over [min, max]; the last bin includes the maximum.

    Integer columns are binned in integer arithmetic. If all values are equal the
    range is widened by `margin` on either side, which puts them in the middle.
    """
    x = F.col(column)
    bounds = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("b")).scalar()
    integral = dict(df.select(x.alias("x")).dtypes)["x"] in ("tinyint", "smallint", "int", "bigint")
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    if integral:
        slot = F.call_function("div", (x - lo) * F.lit(bins), F.nullif(hi - lo, F.lit(0)))
    else:
        slot = F.floor((x - lo) * F.lit(float(bins)) / F.nullif(hi - lo, F.lit(0.0)))
    slot = F.when(hi == lo, F.lit(bins // 2)).otherwise(F.least(slot, F.lit(bins - 1)))
    counts = (
        df.filter(x.isNotNull()).withColumn("_b", bounds)
        .groupBy(slot.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    )
    spread = F.when(hi == lo, F.lit(float(margin))).otherwise(F.lit(0.0))
    left, right = lo.cast("double") - spread, hi.cast("double") + spread
    width = (right - left) / F.lit(float(bins))
    empty = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # At most `bins` rows on either side.
    return (
        empty.join(F.broadcast(counts), "bin", "left").withColumn("_b", bounds)
        .select("bin", (left + F.col("bin") * width).alias("bin_start"),
                F.coalesce("n", F.lit(0)).alias("n"))
    )


def timeline_histogram(flows: DataFrame, bins: int = 60) -> DataFrame:
    """Flows over time; bin starts in seconds."""
    return histogram(flows, "time_us", bins, margin=500_000).withColumn(
        "bin_start", F.col("bin_start") / F.lit(1e6))


def port_app_probability(flows: DataFrame, min_p: float = ProfileParams.min_probability,
                         min_count: int = ProfileParams.min_pair_count) -> DataFrame:
    """P(application | destination port) over labelled flows, for likely pairs.

    Counts flows with a time. Totals come from the pair counts, of which a port
    has one per application.
    """
    pairs = known_applications(flows).groupBy("dst_port", "application").agg(
        F.count("time_us").alias("n"))
    total = F.sum("n").over(Window.partitionBy("dst_port"))
    return (
        pairs.withColumn("port_total", total)
        .withColumn("p", F.try_divide(F.col("n"), F.col("port_total")))
        .filter((F.col("p") >= min_p) & (F.col("n") > min_count))
    )


def port_app_map(likely: DataFrame) -> DataFrame:
    """One row: port as text -> its likely applications, by name."""
    per_port = likely.groupBy(F.coalesce(F.col("dst_port").cast("string"), F.lit("None")).alias("port")).agg(
        F.array_sort(F.collect_set("application")).alias("apps"))
    entries = F.array_sort(F.collect_list(F.struct("port", "apps")))
    return per_port.agg(F.map_from_entries(entries).alias("port_applications"))

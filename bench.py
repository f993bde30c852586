"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the
local cores, BENCH_ONLY a comma-separated choice of queries. BENCH_NAIVE=1 adds
plain forms of four operators for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from flowkeel.operators import assembly, geo  # noqa: E402
from flowkeel.operators.profile import NUMERIC_METRICS, QUANTILE_NAMES  # noqa: E402
from flowkeel.plans.catalog import QUERIES  # noqa: E402
from flowkeel.session import local_session  # noqa: E402
from flowkeel.sources import tables  # noqa: E402


def naive_flow_assembly(spark, sf_dir):
    keys = list(assembly.ENDPOINTS)
    w = Window.partitionBy(*keys).orderBy("ts_us").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = assembly.orient(tables.packets_view(spark, sf_dir)).withColumn("initiator", F.first("src_ip").over(w))
    own = F.col("src_ip") == F.col("initiator")
    return p.groupBy(*keys).agg(
        F.min("ts_us"), F.max("ts_us"), F.min_by("src_ip", "ts_us"), F.min_by("sport", "ts_us"),
        F.min_by("dst_ip", "ts_us"), F.min_by("dport", "ts_us"), F.count_if(own), F.count_if(~own),
        F.sum(F.when(own, F.col("size"))), F.sum(F.when(~own, F.col("size"))))


def naive_geo_range_join(spark, sf_dir):
    dst = geo.destination_counts(tables.flows_view(spark, sf_dir))
    g = tables.geo_view(spark, sf_dir)
    return dst.join(g, (F.col("ip_num") >= F.col("start_ip_num")) & (F.col("ip_num") <= F.col("end_ip_num")))


def naive_quantiles(spark, sf_dir):
    return tables.flows_view(spark, sf_dir).agg(*[
        F.percentile(c, list(QUANTILE_NAMES)).alias(m) for m, (c, _) in NUMERIC_METRICS.items()])


def naive_sliding_window(spark, sf_dir):
    return tables.flows_view(spark, sf_dir).groupBy(
        F.window(F.timestamp_micros("time_us"), "300 seconds", "150 seconds")).agg(
        F.count("*").alias("flows"), F.sum(F.col("src_bytes") + F.col("dst_bytes")).alias("bytes"),
        F.count_distinct("src_ip").alias("sources"), F.count_distinct("dst_ip").alias("destinations"))


NAIVE = [naive_flow_assembly, naive_geo_range_join, naive_quantiles, naive_sliding_window]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session("flowkeel-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: QUERIES[n] for n in only or QUERIES}
    if os.environ.get("BENCH_NAIVE"):
        todo |= {f.__name__: f for f in NAIVE}

    def run(fn):
        start = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("global_summary", "numeric_profile", "features_raw"):
        run(QUERIES[name])
    times = {name: round(run(fn), 3) for name, fn in todo.items()}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

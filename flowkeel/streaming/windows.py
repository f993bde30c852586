"""Traffic per sliding window on a stream of flows."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkeel.streaming.flows import EVENT_TIME, seconds

# Relative standard deviation of the distinct counts.
DISTINCT_ERROR = 0.02


def approx_distinct(column: str, rsd: float) -> Column:
    """Distinct values from a sketch that holds a few bytes per value while they are few, so that quiet windows stay small."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(column, min(21, max(4, ceil(2 * log2(1.106 / rsd))))))


def stream_windowed_traffic(flows: DataFrame, window_sec: int = 300, overlap: float = 0.5, delay_sec: float = 0,
                            rsd: float = DISTINCT_ERROR) -> DataFrame:
    """Flows, volumes and approximate distinct endpoints per window, as `windowed_traffic` has them exactly.

    A stream may not look back over an address's panes, so a flow counts in each window that holds it, and
    distinct endpoints are sketches that grow with them up to a bound, merged in the state. A window comes out once, when
    the watermark has passed its end; a flow that is late for a window is dropped from it by Spark's rule. Flows without a time are in no window.
    """
    slide_sec = round(window_sec * (1 - overlap))
    if not 0 < slide_sec <= window_sec:
        raise ValueError(f"overlap: {overlap!r}")
    timed = flows.filter(F.col("time_us").isNotNull()).withColumn(EVENT_TIME, F.timestamp_micros("time_us"))
    if flows.isStreaming:
        timed = timed.withWatermark(EVENT_TIME, seconds(delay_sec))
    sums = timed.groupBy(F.window(EVENT_TIME, f"{window_sec} seconds", f"{slide_sec} seconds")).agg(
        F.count("*").alias("flows"),
        F.sum(F.col("src_bytes") + F.col("dst_bytes")).alias("bytes"),
        F.sum(F.col("src_packets") + F.col("dst_packets")).alias("packets"),
        approx_distinct("src_ip", rsd).alias("sources"),
        approx_distinct("dst_ip", rsd).alias("destinations"))
    return sums.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                       "flows", "bytes", "packets", "sources", "destinations")

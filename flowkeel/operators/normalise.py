"""Derived columns, filters and reports over loaded flows."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkeel.operators.assembly import UNKNOWN

KEY_COLUMNS = ("time_sec", "src_ip", "dst_ip", "protocol")


def normalise(flows: DataFrame, sort: bool = False) -> DataFrame:
    """Adds seconds, a timestamp, bytes per source packet and byte asymmetry.

    `sort=True` orders the whole output by time; further keys let the range
    partitioning split an instant that many flows share.
    """
    out = flows.withColumns({
        "time_sec": F.col("time_us") / F.lit(1e6),
        "datetime": F.timestamp_micros("time_us"),
        "duration_sec": F.col("duration_us") / F.lit(1e6),
        "src_bpp": F.col("src_bytes") / F.greatest("src_packets", F.lit(1)).cast("double"),
        "byte_asym": (F.col("src_bytes") - F.col("dst_bytes"))
        / F.greatest(F.col("src_bytes") + F.col("dst_bytes"), F.lit(1)).cast("double"),
    })
    return out.orderBy("time_sec", "src_ip", "src_port", "dst_ip", "dst_port") if sort else out


def known_applications(flows: DataFrame) -> DataFrame:
    """Drops unlabelled flows; a null label is dropped too."""
    return flows.filter(F.col("application") != UNKNOWN)


def null_audit(flows: DataFrame, columns: tuple[str, ...] = KEY_COLUMNS) -> DataFrame:
    """Rows and nulls per column, from one pass."""
    counts = flows.agg(F.count("*").alias("_rows"),
                       *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["_rows"], list(columns), "column", "nulls").select(
        "column", F.col("_rows").alias("rows"), "nulls")


def require_keys(flows: DataFrame, columns: tuple[str, ...] = KEY_COLUMNS) -> DataFrame:
    """Drops rows in which a key column is null."""
    return flows.dropna(subset=list(columns))


def windowed_traffic(flows: DataFrame, window_sec: int = 300, overlap: float = 0.5) -> DataFrame:
    """Traffic per sliding window: flows, volumes and distinct endpoints.

    Windows are cut into panes that no window border crosses. Volumes are summed
    per pane and then over the windows that hold it. For the distinct counts each
    address is reduced to the panes it appears in, and from pane to pane it counts
    in the windows that are new to it. So flows are never copied per window, and
    an address has at most one row per pane, however busy it is.
    """
    slide_sec = round(window_sec * (1 - overlap))
    if not 0 < slide_sec <= window_sec:
        raise ValueError(f"overlap: {overlap!r}")
    pane_us = gcd(window_sec, slide_sec) * 1_000_000
    window, slide = window_sec * 1_000_000, slide_sec * 1_000_000
    t = F.col("time_us")

    def last_start(p: Column) -> Column:
        return p - F.pmod(p, F.lit(slide))

    def first_start(p: Column) -> Column:
        """The earliest window that reaches to the end of the pane."""
        reach = F.lit(window - pane_us) - (p - last_start(p))
        return last_start(p) - F.call_function("div", reach, F.lit(slide)) * slide

    def starts(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(first, last, F.lit(slide).cast("bigint"))).alias("start_us")

    placed = flows.filter(t.isNotNull()).withColumn("pane", t - F.pmod(t, F.lit(pane_us)))
    p = F.col("pane")
    volumes = (
        placed.groupBy("pane")
        .agg(F.count("*").alias("flows"),
             F.sum(F.col("src_bytes") + F.col("dst_bytes")).alias("bytes"),
             F.sum(F.col("src_packets") + F.col("dst_packets")).alias("packets"))
        .select(starts(first_start(p), last_start(p)), "flows", "bytes", "packets")
        .groupBy("start_us").agg(*[F.sum(c).alias(c) for c in ("flows", "bytes", "packets")])
    )
    before = F.lag("pane").over(Window.partitionBy("side", "ip").orderBy("pane"))
    endpoints = (
        placed.unpivot(["pane"], ["src_ip", "dst_ip"], "side", "ip").filter(F.col("ip").isNotNull()).distinct()
        .withColumn("from", F.coalesce(F.greatest(first_start(p), last_start(before) + slide), first_start(p)))
        .filter(F.col("from") <= last_start(p))
        .select(starts(F.col("from"), last_start(p)), "side")
        .groupBy("start_us").agg(F.count_if(F.col("side") == "src_ip").alias("sources"),
                                 F.count_if(F.col("side") == "dst_ip").alias("destinations"))
    )
    return volumes.join(endpoints, "start_us", "left").select(
        F.timestamp_micros("start_us").alias("window_start"),
        F.timestamp_micros(F.col("start_us") + window).alias("window_end"),
        "flows", "bytes", "packets",
        F.coalesce("sources", F.lit(0)).alias("sources"),
        F.coalesce("destinations", F.lit(0)).alias("destinations"))

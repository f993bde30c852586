"""Countries of addresses through a backward as-of join on integer ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkeel.functions.net import ip_to_int
from flowkeel.operators.lookup import BROADCAST_ROWS, fits_broadcast

BUCKET_BITS = 16


def _bucket(number: Column, bits: int) -> Column:
    return F.shiftright(number, bits)


def effective_ranges(geo: DataFrame, label: str = "country_name", bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Non-overlapping ranges that give the as-of answer by plain containment.

    As-of looks at the nearest start only, so a range ends where the next one
    starts even if it claims to run on. Equal starts keep the largest end, then
    the largest label. The next start is found within address buckets, plus one
    row per bucket for the step to the next bucket, so no task sees all ranges.
    """
    start, end = F.col("start_ip_num"), F.col("end_ip_num")
    ranges = (
        geo.select(start.cast("bigint").alias("start_ip_num"), end.cast("bigint").alias("end_ip_num"),
                   F.col(label).alias(label))
        .filter(start.isNotNull())
        .groupBy("start_ip_num")
        .agg(F.max(F.struct(F.col("end_ip_num"), F.col(label))).alias("r"))
        .select("start_ip_num", "r.end_ip_num", f"r.{label}",
                _bucket(start, bucket_bits).alias("bucket"))
    )
    # At most 2^(32 - bucket_bits) rows.
    heads = ranges.groupBy("bucket").agg(F.min("start_ip_num").alias("head"))
    heads = heads.select("bucket", F.lead("head").over(Window.orderBy("bucket")).alias("next_head"))
    in_bucket = F.lead("start_ip_num").over(Window.partitionBy("bucket").orderBy("start_ip_num"))
    next_start = F.coalesce(F.col("next_in_bucket"), F.col("next_head"))
    return (
        ranges.withColumn("next_in_bucket", in_bucket)
        .join(heads, "bucket", "left")
        .withColumn("eff_end", F.least(end, F.coalesce(next_start - 1, end)))
        .filter(F.col("eff_end") >= start)
        .select("start_ip_num", "end_ip_num", "eff_end", label)
    )


def _asof_by_lookup(left: DataFrame, geo: DataFrame, key: str, label: str, bits: int) -> DataFrame:
    """Broadcasts the effective ranges, one row per address bucket they touch."""
    ranges = effective_ranges(geo, label, bits).withColumn("_bucket", F.explode(F.sequence(
        _bucket(F.col("start_ip_num"), bits), _bucket(F.col("eff_end"), bits))))
    covers = (F.col(key) >= F.col("start_ip_num")) & (F.col(key) <= F.col("eff_end"))
    return (
        left.withColumn("_bucket", _bucket(F.col(key), bits))
        .join(F.broadcast(ranges), "_bucket").filter(covers)
        .select(*left.columns, "start_ip_num", "end_ip_num", label)
    )


def _asof_by_sweep(left: DataFrame, geo: DataFrame, key: str, label: str, bits: int) -> DataFrame:
    """Sorts keys and range starts together and carries the last start forward.

    Works bucket by bucket; every bucket opens with the range that was current at
    its border. No pair of key and range is formed.
    """
    start = F.col("start_ip_num")
    latest = F.struct(start.cast("bigint").alias("start_ip_num"),
                      F.col("end_ip_num").cast("bigint").alias("end_ip_num"),
                      F.col(label).alias(label))
    ranges = (
        geo.filter(start.isNotNull()).groupBy(start.cast("bigint").alias("num"))
        .agg(F.max(latest).alias("r"))
        .withColumn("_bucket", _bucket(F.col("num"), bits))
    )
    # One row per address bucket: 2^(32 - bits).
    tails = ranges.groupBy("_bucket").agg(F.max("r").alias("tail"))
    buckets = left.sparkSession.range(1 << (32 - bits)).select(F.col("id").alias("_bucket"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    opening = (
        buckets.join(tails, "_bucket", "left")
        .select("_bucket", F.shiftleft("_bucket", bits).alias("num"),
                F.last("tail", ignorenulls=True).over(before).alias("r"))
        .filter(F.col("r").isNotNull())
    )
    none = F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType)
    events = (
        opening.select("_bucket", "num", F.lit(0).alias("kind"), "r", none.alias("k"))
        .unionAll(ranges.select("_bucket", "num", F.lit(1).alias("kind"), "r", none.alias("k")))
        .unionAll(left.select(
            _bucket(F.col(key), bits).alias("_bucket"), F.col(key).alias("num"), F.lit(2).alias("kind"),
            F.lit(None).cast(ranges.schema["r"].dataType).alias("r"), F.struct(*left.columns).alias("k")))
    )
    upto = Window.partitionBy("_bucket").orderBy("num", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumn("r", F.last("r", ignorenulls=True).over(upto))
        .filter((F.col("kind") == 2) & (F.col("num") <= F.col("r.end_ip_num")))
        .select("k.*", "r.*")
    )


def asof_interval_join(left: DataFrame, geo: DataFrame, key: str, label: str = "country_name",
                       bucket_bits: int = BUCKET_BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of unique integer keys to the nearest range at or below, if it covers them.

    Both ways meet on address buckets, which hold at most 2^bucket_bits unique
    keys. Ranges are broadcast if counting finds few of them (buckets add at most
    one row each, as effective ranges do not overlap); otherwise both sides are
    shuffled and swept.
    """
    few = fits_broadcast(geo, broadcast_rows)
    return (_asof_by_lookup if few else _asof_by_sweep)(left, geo, key, label, bucket_bits)


def destination_counts(flows: DataFrame) -> DataFrame:
    """Flows per destination with its number; a text no address parses to 0.

    The number names the count, which is never 0, so that no filter on it can
    be moved ahead of the aggregation and parse every row.
    """
    parsed = F.when(F.col("flow_count") > 0, ip_to_int(F.col("dst_ip")))
    return flows.groupBy("dst_ip").agg(F.count("*").alias("flow_count")).withColumn("ip_num", parsed)


def locate_destinations(flows: DataFrame, geo: DataFrame, **kw) -> DataFrame:
    """Country per destination address, for the addresses a range covers.

    Any number of texts may parse to 0. They skip the join, where they would fill
    one bucket: only a range that starts at 0 can cover them.
    """
    counts = destination_counts(flows)
    parsed = counts.filter(F.col("ip_num") != 0)
    at_zero = geo.filter(F.col("start_ip_num") == 0).agg(F.max(F.struct(
        F.col("end_ip_num").cast("bigint").alias("end_ip_num"), "country_name"))).scalar()
    unparsed = (
        counts.filter(F.col("ip_num") == 0).withColumn("_r", at_zero)
        .filter(F.col("_r.end_ip_num") >= 0)
        .select("dst_ip", "flow_count", "ip_num", F.lit(0).cast("bigint").alias("start_ip_num"), "_r.*")
    )
    located = asof_interval_join(parsed, geo, "ip_num", **kw)
    return located.select(unparsed.columns).unionAll(unparsed)


def country_counts(flows: DataFrame, geo: DataFrame, **kw) -> DataFrame:
    """Flows per country; ranges without a name do not count.

    Flows are reduced to one row per address before the join, and all unparsable
    texts to one.
    """
    numbers = destination_counts(flows).groupBy("ip_num").agg(F.sum("flow_count").alias("flow_count"))
    return (
        asof_interval_join(numbers, geo, "ip_num", **kw).filter(F.col("country_name").isNotNull())
        .groupBy("country_name").agg(F.sum("flow_count").alias("flow_count"))
    )


def top_countries(flows: DataFrame, geo: DataFrame, n: int = 15, **kw) -> DataFrame:
    """The `n` most frequent destination countries; ties by name."""
    return country_counts(flows, geo, **kw).orderBy(F.desc("flow_count"), "country_name").limit(n)

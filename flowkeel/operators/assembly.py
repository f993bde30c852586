"""Packets to bidirectional flows, and their application labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkeel.schema import FLOW_COLUMNS

# Well-known port to application.
WELL_KNOWN_PORTS = {
    21: "FTP",
    22: "SSH",
    80: "HTTP",
    443: "SSL",
    389: "LDAP",
    3268: "LDAP",
}
UNKNOWN = "UNKNOWN"

ENDPOINTS = ("ip_a", "port_a", "ip_b", "port_b", "proto")


def orient(packets: DataFrame) -> DataFrame:
    """Adds the direction-free key and whether the packet runs from a to b.

    The smaller (address text, port) endpoint is a, so both directions of a
    conversation share a key.
    """
    src, dst = F.col("src_ip"), F.col("dst_ip")
    fwd = (src < dst) | ((src == dst) & (F.col("sport") <= F.col("dport")))

    def pick(a: str, b: str):
        return F.when(F.col("fwd"), F.col(a)).otherwise(F.col(b))

    return packets.withColumn("fwd", fwd).withColumns({
        "ip_a": pick("src_ip", "dst_ip"),
        "port_a": pick("sport", "dport"),
        "ip_b": pick("dst_ip", "src_ip"),
        "port_b": pick("dport", "sport"),
    })


def flow_states(packets: DataFrame, per: tuple[str | Column, ...] = ()) -> DataFrame:
    """Sums of every conversation, from which its flow follows and which merge with those of other packets.

    The initiator sent the earliest packet; on equal times direction a to b wins.
    A key has only two endpoints, so the initiator is one bit: it rides in the
    lowest bit of the minimum of `2 * ts_us + (0 if a to b else 1)`. All buffers are
    longs, which keeps this one hash aggregation with map-side combine and no sort.
    """
    fwd = F.col("fwd")
    one_way = lambda c: F.sum(F.when(fwd, c).otherwise(F.lit(0).cast("bigint")))
    return (
        orient(packets)
        .groupBy(*per, *ENDPOINTS)
        .agg(
            F.min(F.col("ts_us") * 2 + F.when(fwd, 0).otherwise(1)).alias("first"),
            F.max("ts_us").alias("last_us"),
            F.count("*").alias("n"),
            F.sum("size").alias("bytes"),
            one_way(F.lit(1).cast("bigint")).alias("n_fwd"),
            one_way(F.col("size")).alias("bytes_fwd"),
        )
    )


def merge_states(states: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """One state per conversation from states of parts of its packets, in any order."""
    return states.groupBy(*per, *ENDPOINTS).agg(
        F.min("first").alias("first"), F.max("last_us").alias("last_us"),
        *[F.sum(c).alias(c) for c in ("n", "bytes", "n_fwd", "bytes_fwd")])


def flows_of_states(sums: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """The unlabelled flow of every conversation's state.

    Where both addresses are equal every packet counts as sent by the source.
    """
    from_a = F.col("first").bitwiseAND(F.lit(1).cast("bigint")) == 0
    loop = F.col("ip_a") == F.col("ip_b")

    def source(total: str, forward: str):
        return (F.when(loop, F.col(total)).when(from_a, F.col(forward))
                .otherwise(F.col(total) - F.col(forward)))

    start = F.shiftright(F.col("first"), 1)
    flows = sums.select(
        *per,
        start.alias("time_us"),
        (F.col("last_us") - start).alias("duration_us"),
        F.when(from_a, F.col("ip_a")).otherwise(F.col("ip_b")).alias("src_ip"),
        F.when(from_a, F.col("port_a")).otherwise(F.col("port_b")).alias("src_port"),
        F.when(from_a, F.col("ip_b")).otherwise(F.col("ip_a")).alias("dst_ip"),
        F.when(from_a, F.col("port_b")).otherwise(F.col("port_a")).alias("dst_port"),
        F.col("proto").alias("protocol"),
        source("n", "n_fwd").alias("src_packets"),
        source("bytes", "bytes_fwd").alias("src_bytes"),
        "n", "bytes",
    )
    return (
        flows
        .withColumn("dst_packets", F.col("n") - F.col("src_packets"))
        .withColumn("dst_bytes", F.col("bytes") - F.col("src_bytes"))
        .withColumn("dual", F.when((F.col("src_packets") > 0) & (F.col("dst_packets") > 0), 1).otherwise(0))
        .drop("n", "bytes")
    )


def assemble_flows(packets: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """One unlabelled flow per conversation, with no idle timeout.

    `per` adds key columns, e.g. `("file",)` for one set of flows per capture.
    """
    return flows_of_states(flow_states(packets, per), per)


def port_dimension(spark: SparkSession, ports: dict[int, str] | None = None) -> DataFrame:
    rows = sorted((WELL_KNOWN_PORTS if ports is None else ports).items())
    return spark.createDataFrame(rows, "port int, app string")


def label_application(flows: DataFrame, ports: dict[int, str] | None = None) -> DataFrame:
    """Names the application by source port, else destination port, else UNKNOWN."""
    dim = port_dimension(flows.sparkSession, ports)
    by_src = F.broadcast(dim.select(F.col("port").alias("src_port"), F.col("app").alias("_app_src")))
    by_dst = F.broadcast(dim.select(F.col("port").alias("dst_port"), F.col("app").alias("_app_dst")))
    return (
        flows.join(by_src, "src_port", "left").join(by_dst, "dst_port", "left")
        .withColumn("application", F.coalesce("_app_src", "_app_dst", F.lit(UNKNOWN)))
        .drop("_app_src", "_app_dst")
    )


def finish_flows(flows: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """The flow columns in file order."""
    return flows.select(*per, *FLOW_COLUMNS)


def packets_to_flows(packets: DataFrame, ports: dict[int, str] | None = None,
                     per: tuple[str, ...] = ()) -> DataFrame:
    return finish_flows(label_application(assemble_flows(packets, per), ports), per)

"""Frames to packets: header fields as native column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkeel.functions.net import hex_byte, hex_int, hex_ip

# Header layout.
MIN_FRAME_BYTES = 34
ETHERTYPE_IPV4 = "0800"
TCP, UDP = 6, 17
ETHERNET_BYTES = 14


def decode_packets(frames: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keeps IPv4 TCP/UDP frames that reach both ports and decodes them.

    `keep` names frame columns (such as `file`) to carry along. Where there is a column
    `caplen`, `frame` may hold no more than the first bytes of so many.
    """
    captured = F.col("caplen") if "caplen" in frames.columns else F.length("frame").cast("bigint")
    head = F.hex(F.substring("frame", 1, MIN_FRAME_BYTES))
    l4 = F.col("_l4")
    ports = F.hex(F.substring(F.col("frame"), l4 + 1, F.lit(4)))
    return (
        frames
        .filter(captured >= MIN_FRAME_BYTES)
        .withColumn("_head", head)
        .filter(F.substring("_head", 25, 4) == ETHERTYPE_IPV4)
        .withColumn("_proto", hex_byte(F.col("_head"), 23))
        .filter(F.col("_proto").isin(TCP, UDP))
        .withColumn("_l4", ETHERNET_BYTES + 4 * hex_byte(F.col("_head"), 14).bitwiseAND(15))
        .filter(captured >= l4 + 4)
        .withColumn("_ports", ports)
        .select(
            *keep,
            F.col("ts_us").cast("bigint").alias("ts_us"),
            hex_ip(F.col("_head"), 26).alias("src_ip"),
            hex_ip(F.col("_head"), 30).alias("dst_ip"),
            hex_int(F.substring("_ports", 1, 4)).alias("sport"),
            hex_int(F.substring("_ports", 5, 4)).alias("dport"),
            F.when(F.col("_proto") == TCP, "TCP").otherwise("UDP").alias("proto"),
            F.coalesce("wirelen", captured).cast("bigint").alias("size"),
        )
    )

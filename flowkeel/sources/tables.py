"""Network-shaped views over the star-schema tables.

Only integer arithmetic and `floor`, so that any SQL engine can state the same
view.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkeel.functions.net import int_to_ip
from flowkeel.schema import FLOW_COLUMNS
from flowkeel.session import ship_package

# Server address and port per event type.
SERVERS = {
    "view": ("192.168.1.1", 80),
    "click": ("192.168.1.2", 443),
    "purchase": ("192.168.1.3", 22),
    "signup": ("192.168.1.4", 389),
    "error": ("192.168.1.5", 53),
}
# Destination port per part size modulo 8.
SIZE_PORTS = [21, 22, 80, 443, 389, 3268, 53, 8080]
# Application that a port runs.
PORT_APPS = {21: "FTP", 22: "SSH", 80: "HTTP", 443: "SSL", 389: "LDAP", 3268: "LDAP", 53: "DNS", 8080: "DNS"}
# Application per part type.
TYPE_APPS = {"STANDARD": "HTTP", "SMALL": "SSL", "LARGE": "DNS", "PROMO": "SSH", "ECONOMY": "FTP", "MEDIUM": "LDAP"}
# Protocol per return flag.
FLAG_PROTOCOLS = {"A": "TCP", "N": "UDP", "R": "ICMP"}

GEO_BASE = 2886729728  # 172.16.0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(key: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def micros(ts: str) -> Column:
    """A zoneless timestamp as microseconds, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def packets_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets between a client per user and a server per event type."""
    user = F.col("user_id")
    client_ip = F.concat_ws(".", F.lit("10.0"), F.floor(user / 256).cast("string"), (user % 256).cast("string"))
    client_port = (32768 + user % 1000).cast("int")
    server_ip = _choose(F.col("event_type"), {k: v[0] for k, v in SERVERS.items()})
    server_port = _choose(F.col("event_type"), {k: v[1] for k, v in SERVERS.items()})
    up = F.col("event_id") % 3 != 0
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        micros("ts").alias("ts_us"),
        F.when(up, client_ip).otherwise(server_ip).alias("src_ip"),
        F.when(up, server_ip).otherwise(client_ip).alias("dst_ip"),
        F.when(up, client_port).otherwise(server_port).alias("sport"),
        F.when(up, server_port).otherwise(client_port).alias("dport"),
        F.when(user % 4 == 0, "UDP").otherwise("TCP").alias("proto"),
        (40 + F.floor(F.col("value") * 10)).cast("bigint").alias("size"),
    )


def frames_view(packets: DataFrame) -> DataFrame:
    """Packets encoded as Ethernet/IPv4 frames of header and ports.

    A number above 255 in an address carries into the one before it, so that every client keeps
    an address of its own: 10.0.256.1 is sent as 10.1.0.1. More than four bytes are an error.
    """
    def u16(c: Column) -> Column:
        return F.lpad(F.hex(c.cast("bigint")), 4, "0")

    def digits8(n: Column) -> Column:
        return F.when(n < 1 << 32, F.lpad(F.hex(n), 8, "0")).when(n.isNotNull(), F.raise_error(F.lit("no address of four bytes")).cast("string"))

    def ip(c: str) -> Column:
        return F.aggregate(F.split(F.col(c), r"\."), F.lit(0).cast("bigint"), lambda n, o: n * 256 + o.cast("bigint"), digits8)

    proto = F.when(F.col("proto") == "TCP", "06").otherwise("11")
    digits = F.concat(
        F.lit("02" * 12 + "0800" + "4500"), F.lit("0018" + "00000000" + "40"), proto, F.lit("0000"),
        ip("src_ip"), ip("dst_ip"), u16(F.col("sport")), u16(F.col("dport")))
    return packets.select(
        F.lit("events").alias("file"), "ord", "ts_us", F.col("size").alias("wirelen"),
        F.unhex(digits).alias("frame"))


def flows_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as flows: source per order, destination per part."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    k, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    port = F.col("dst_port")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
        parts, lines.l_partkey == parts.p_partkey)
    own = (k + line) % 3 == 0
    app = (F.when(F.col("l_linenumber") == 7, "UNKNOWN").when(own, _choose(port, PORT_APPS))
           .otherwise(_choose(F.col("p_type"), TYPE_APPS)))
    return (
        joined
        .withColumn("dst_port", F.element_at(
            F.array(*[F.lit(p) for p in SIZE_PORTS]), (F.col("p_size") % 8 + 1).cast("int")))
        .withColumns({
            "time_us": micros("l_shipdate") + (k * 131 + line) % 86400 * 1_000_000,
            "duration_us": 500 + (k * 7919 + line * 104729) % 2_000_000,
            "src_ip": int_to_ip(F.lit(10 << 24).cast("bigint") + k % (1 << 24)),
            "src_port": (32768 + k % 28232).cast("int"),
            "dst_ip": int_to_ip(F.lit(GEO_BASE) + F.col("l_partkey") % 2500),
            "protocol": _choose(F.col("l_returnflag"), FLAG_PROTOCOLS),
            "application": app,
            "src_packets": F.floor("l_quantity").cast("bigint"),
            "dst_packets": F.floor(F.col("l_quantity") * line).cast("bigint") % 20,
            "src_bytes": F.floor("l_extendedprice").cast("bigint"),
            "dst_bytes": F.floor("o_totalprice").cast("bigint") % 15000,
        })
        .withColumn("dual", F.when((F.col("src_packets") > 0) & (F.col("dst_packets") > 0), 1).otherwise(0))
        .select(*FLOW_COLUMNS)
    )


def geo_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as address ranges, some overlapping the next and some leaving gaps."""
    k = F.col("n_nationkey").cast("bigint")
    start = F.lit(GEO_BASE) + k * 100
    width = F.when(k % 7 == 0, 149).when(k % 5 == 0, 49).otherwise(99)
    return table(spark, sf_dir, "nation").select(
        start.alias("start_ip_num"), (start + width).alias("end_ip_num"), F.col("n_name").alias("country_name"))


def pcap_records(ts: list[int], wire: list[int], frames: list[bytes], first: bool) -> bytes:
    """Records in microseconds, behind the file's header if they are its first."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)] if first else []
    out += [struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(f), w) + f for t, w, f in zip(ts, wire, frames, strict=True)]
    return b"".join(out)


def pcapng_blocks(ts: list[int], wire: list[int], frames: list[bytes], first: bool, section: int = 400) -> bytes:
    """Sections in either byte order by turns, with an interface in microseconds and one in nanoseconds for every second packet."""
    out = []

    def block(order: str, kind: int, body: bytes) -> None:
        body += bytes(-len(body) % 4)
        size = struct.pack(order + "I", len(body) + 12)
        out.append(struct.pack(order + "I", kind) + size + body + size)

    order = "<"
    for i, (t, w, f) in enumerate(zip(ts, wire, frames, strict=True)):
        if i % section == 0:
            order = "<>"[i // section % 2]
            block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
            block(order, 1, struct.pack(order + "HHI", 1, 0, 65535))
            block(order, 1, struct.pack(order + "HHIHHBxxx", 1, 0, 65535, 9, 1, 9))
        ticks = t * 1000 if i % 2 else t
        block(order, 6, struct.pack(order + "IIIII", i % 2, ticks >> 32, ticks & 0xFFFFFFFF, len(f), w) + f)
    return b"".join(out)


def write_captures(frames: DataFrame, folder: str, files: int = 4, ng: bool = False) -> None:
    """Writes frames as pcap or pcapng files, one per time range, like rotated captures."""
    written = pcapng_blocks if ng else pcap_records

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        uri = "file://" + folder if folder.startswith("/") else re.sub(r"^file:/+", "file:///", folder)
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path)
        part = TaskContext.get().partitionId()
        name = f"{path}/part-{part:05d}.pcap" + "ng" * ng
        attempt = f"{name}.{TaskContext.get().taskAttemptId()}"
        n = 0
        with system.open_output_stream(attempt) as out:
            for b in batches:
                out.write(written(*(b.column(c).to_pylist() for c in ("ts_us", "wirelen", "frame")), n == 0))
                n += b.num_rows
            if not n:
                out.write(pcap_records([], [], [], True))
        system.move(attempt, name)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    ship_package(frames.sparkSession)
    ordered = frames.repartitionByRange(files, "ts_us").sortWithinPartitions("ts_us", "ord")
    ordered.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()

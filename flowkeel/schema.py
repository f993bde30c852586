"""Column names and types shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

FRAMES_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("wirelen", T.LongType()),
    T.StructField("frame", T.BinaryType()),
])

# Frames of which only the first bytes are carried, with the number captured.
HEADS_SCHEMA = T.StructType([*FRAMES_SCHEMA.fields, T.StructField("caplen", T.LongType())])

PACKETS_SCHEMA = T.StructType([
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("sport", T.IntegerType()),
    T.StructField("dport", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("size", T.LongType()),
])

# What is kept of a conversation, to be merged with what later captures hold of it.
STATES_SCHEMA = T.StructType([
    T.StructField("ip_a", T.StringType()),
    T.StructField("port_a", T.IntegerType()),
    T.StructField("ip_b", T.StringType()),
    T.StructField("port_b", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("first", T.LongType()),
    T.StructField("last_us", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("n_fwd", T.LongType()),
    T.StructField("bytes_fwd", T.LongType()),
])

FLOWS_SCHEMA = T.StructType([
    T.StructField("time_us", T.LongType()),
    T.StructField("duration_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("dual", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("application", T.StringType()),
    T.StructField("src_packets", T.LongType()),
    T.StructField("dst_packets", T.LongType()),
    T.StructField("src_bytes", T.LongType()),
    T.StructField("dst_bytes", T.LongType()),
])
FLOW_COLUMNS = FLOWS_SCHEMA.names

# Names the flow files and the baseline document use.
SPACED_NAMES = {
    "time_us": "TIME",
    "duration_us": "DURATION",
    "src_ip": "SRC IP",
    "src_port": "SRC PORT",
    "dst_ip": "DST IP",
    "dst_port": "DST PORT",
    "dual": "DUAL",
    "protocol": "PROTOCOL",
    "application": "APPLICATION",
    "src_packets": "SRC PACKETS",
    "dst_packets": "DST PACKETS",
    "src_bytes": "SRC BYTES",
    "dst_bytes": "DST BYTES",
}

# Microseconds per unit as (multiplier, divisor).
TIME_UNITS = {
    "s": (1_000_000, 1),
    "ms": (1_000, 1),
    "us": (1, 1),
    "ns": (1, 1_000),
}


@dataclass(frozen=True)
class FlowSchema:
    """Maps canonical flow columns to the physical names of a file set."""

    names: dict[str, str] = field(default_factory=lambda: dict(SPACED_NAMES))

    def physical(self, column: str) -> str:
        return self.names[column]

    def renamed(self, **overrides: str) -> FlowSchema:
        unknown = set(overrides) - set(self.names)
        if unknown:
            raise ValueError(f"unknown flow columns: {sorted(unknown)}")
        return FlowSchema({**self.names, **overrides})

    @classmethod
    def from_config(cls, cfg: dict, base: FlowSchema | None = None) -> FlowSchema:
        """Applies the `time_col`, `src_ip_col`, `dst_ip_col`, `protocol_col` keys."""
        roles = {"time_col": "time_us", "src_ip_col": "src_ip",
                 "dst_ip_col": "dst_ip", "protocol_col": "protocol"}
        base = base or SPACED
        return base.renamed(**{roles[k]: v for k, v in cfg.items() if k in roles})


SPACED = FlowSchema()
UNDERSCORE = FlowSchema({k: v.replace(" ", "_") for k, v in SPACED_NAMES.items()})

# Baseline document, as written by `build_baseline` and read by training.
_PROFILE = "min: double, max: double, mean: double, stddev: double, p25: double, " \
           "median: double, p75: double, p95: double, p99: double, p999: double, iqr: double"
BASELINE_DDL = f"""
global_summary struct<total_records: bigint, file_timespan_seconds: double,
    total_bytes_transferred: bigint, total_packets_transferred: bigint,
    file_avg_bytes_per_sec: double, file_avg_packets_per_sec: double>,
geo_profile struct<top_countries: map<string, bigint>, error: string>,
numerical_profiles map<string, struct<{_PROFILE}>>,
ratio_profiles map<string, struct<median: double, p95: double, p99: double>>,
global_entropy map<string, double>,
structural_limits struct<max_unique_dst_ips_per_src: bigint, p95_unique_dst_ips_per_src: double,
    max_unique_dst_ports_per_src: bigint, p95_unique_dst_ports_per_src: double>,
categorical_baselines struct<rare_src_ips_sample: array<string>, rare_dst_ips_sample: array<string>,
    probabilistic_port_applications: map<string, array<string>>>
""".replace("\n", " ")

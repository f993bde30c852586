from flowkeel.schema import FLOWS_SCHEMA

FLOW_DEFAULTS = dict(time_us=1_000_000, duration_us=0, src_ip="10.0.0.1", src_port=40000, dst_ip="8.8.8.8",
                     dst_port=80, dual=0, protocol="TCP", application="HTTP", src_packets=1, dst_packets=0,
                     src_bytes=100, dst_bytes=0)


def make_flows(spark, *rows):
    """Flow rows that name only what differs from the defaults."""
    return spark.createDataFrame([tuple({**FLOW_DEFAULTS, **r}.values()) for r in rows], FLOWS_SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()

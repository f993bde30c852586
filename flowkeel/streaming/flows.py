"""Flows with an idle timeout, from packets at rest or as they arrive.

A conversation that is silent for as long as the timeout ends, and its next packet begins a new
flow. This is a session window over the conversation's key, with the sums of `flow_states` as
buffers. A batch and a stream run the same plan. In a stream a flow leaves the state once the
watermark, the latest packet less the delay, has passed its end; packets older than that are
late and dropped by Spark's rule. So the state holds the conversations of the last timeout
and delay, whatever the stream's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkeel.operators.assembly import finish_flows, flow_states, flows_of_states, label_application

SESSION = "session_window"
EVENT_TIME = "event_time"


def seconds(n: float) -> str:
    return f"{round(n * 1_000_000)} microseconds"


def session_states(packets: DataFrame, idle_sec: float, delay_sec: float = 0) -> DataFrame:
    """A state per conversation and session. Packets without a time belong to none; the delay matters to streams only."""
    if idle_sec <= 0:
        raise ValueError(f"idle_sec: {idle_sec!r}")
    timed = packets.filter(F.col("ts_us").isNotNull()).withColumn(EVENT_TIME, F.timestamp_micros("ts_us"))
    if packets.isStreaming:
        timed = timed.withWatermark(EVENT_TIME, seconds(delay_sec))
    return flow_states(timed, (F.session_window(EVENT_TIME, seconds(idle_sec)),))


def idle_flows(packets: DataFrame, idle_sec: float, ports: dict[int, str] | None = None, delay_sec: float = 0) -> DataFrame:
    """The flows of `packets`, cut where a conversation is silent for longer than `idle_sec`.

    A packet that comes just `idle_sec` after the one before still belongs to its flow. Without
    such gaps these are the flows of `packets_to_flows`. From a stream, flows come out once, when they are over.
    """
    return finish_flows(label_application(flows_of_states(session_states(packets, idle_sec, delay_sec)), ports))

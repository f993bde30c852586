"""Flow assembly job: capture files to flow Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowkeel.operators.assembly import finish_flows, flow_states, flows_of_states, label_application, merge_states, packets_to_flows
from flowkeel.operators.packets import decode_packets
from flowkeel.sources.captures import SPLIT_BYTES, read_frames
from flowkeel.sources.flows import write_flows
from flowkeel.sources.states import read_states, write_load


def capture_flows(spark: SparkSession, path: str | list[str], ports: dict[int, str] | None = None,
                  per_capture: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Flows of the captures, taken together or one set per file."""
    per = ("file",) if per_capture else ()
    packets = decode_packets(read_frames(spark, path, split_bytes), keep=per)
    return packets_to_flows(packets, ports, per)


def capture_job(spark: SparkSession, path: str | list[str], out: str, **kw) -> None:
    """Writes the flows under the spaced names."""
    write_flows(capture_flows(spark, path, **kw), out)


def add_captures(spark: SparkSession, path: str | list[str], store: str, load: str, split_bytes: int = SPLIT_BYTES) -> None:
    """Adds further captures to a store of conversation states, of which only the new captures are read.

    A load that is repeated under its name, say after a failure, counts once.
    """
    write_load(flow_states(decode_packets(read_frames(spark, path, split_bytes))), store, load)


def stored_flows(spark: SparkSession, store: str, ports: dict[int, str] | None = None, loads: list[str] | None = None) -> DataFrame:
    """The flows of all captures in the store, as `capture_flows` finds them in the captures together.

    States are as many as conversations, not packets; one aggregation with map-side combine merges them.
    """
    return finish_flows(label_application(flows_of_states(merge_states(read_states(spark, store, loads))), ports))


def compact_store(spark: SparkSession, store: str, new_store: str, load: str) -> None:
    """Writes the merged states of a store as the first load of a new one. The old store stays until its owner drops it."""
    write_load(merge_states(read_states(spark, store)), new_store, load)

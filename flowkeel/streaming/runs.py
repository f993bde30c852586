"""Runs of streams that end when all that has arrived is done."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_arrived(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends to Parquet what the files that arrived since the last run add, and returns.

    The checkpoint folder carries the seen files, the state and the watermark from run to
    run, and the sink's log makes a repeated batch count once; both must lie on shared storage.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(out).awaitTermination()

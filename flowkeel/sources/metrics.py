"""Run metrics as an append-only table `(run_id, tag, step, value)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Metric tags.
THRESHOLD, ANOMALIES = "Inference/Threshold", "Inference/Anomalies_Found"
ERRORS = "Inference/Reconstruction_Errors"


def scoring_metrics(summary: DataFrame, histogram: DataFrame) -> DataFrame:
    """Threshold, anomaly count and error histogram as `(tag, step, value)`."""
    scalars = summary.select(
        F.col("threshold").alias(THRESHOLD), F.col("anomalies").cast("double").alias(ANOMALIES),
    ).unpivot([], [THRESHOLD, ANOMALIES], "tag", "value")
    return scalars.select("tag", F.lit(0).cast("bigint").alias("step"), "value").unionAll(
        histogram.select(F.lit(ERRORS).alias("tag"),
                         F.col("bin").cast("bigint").alias("step"), F.col("n").cast("double").alias("value")))


def append_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    metrics.select(F.lit(run_id).alias("run_id"), "tag", "step", "value").write.mode("append").parquet(path)

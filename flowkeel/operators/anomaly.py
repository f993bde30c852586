"""Global three-sigma rule over any score column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkeel.operators.profile import histogram


def sigma_threshold(df: DataFrame, score: str = "recon_error", k: float = 3.0) -> DataFrame:
    """One row `(records, mean, stddev, threshold)`; nulls throughout if there are no scores."""
    s = F.col(score)
    return df.agg(F.count(s).alias("records"), F.avg(s).alias("mean"),
                  F.stddev_pop(s).alias("stddev")).withColumn(
        "threshold", F.col("mean") + F.lit(float(k)) * F.col("stddev"))


def _cut(df: DataFrame, score: str, k: float) -> Column:
    return sigma_threshold(df, score, k).select("threshold").scalar()


def flag_anomalies(df: DataFrame, score: str = "recon_error", k: float = 3.0,
                   threshold: float | Column | None = None) -> DataFrame:
    """Adds `is_anomaly`: strictly above the threshold, which `df` itself gives if none is passed."""
    cut = _cut(df, score, k) if threshold is None else threshold
    cut = cut if isinstance(cut, Column) else F.lit(float(cut))
    return df.withColumn("is_anomaly", F.coalesce(F.col(score) > cut, F.lit(False)))


def anomaly_summary(df: DataFrame, score: str = "recon_error", k: float = 3.0) -> DataFrame:
    """One row: records, mean, deviation, threshold, anomalies and the highest score."""
    s = F.col(score)
    counts = flag_anomalies(df, score, k).agg(
        F.count_if("is_anomaly").alias("anomalies"),
        F.coalesce(F.max(s), F.lit(0.0)).alias("max_error"))
    stats = sigma_threshold(df, score, k).select(F.struct("*")).scalar()
    return counts.withColumn("_s", stats).select("_s.*", "anomalies", "max_error")


def error_histogram(df: DataFrame, score: str = "recon_error", bins: int = 60) -> DataFrame:
    return histogram(df, score, bins)

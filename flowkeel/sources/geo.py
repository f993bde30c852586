"""Address range dimension."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_geo(spark: SparkSession, path: str) -> DataFrame:
    """Three columns of a range file; unsigned 32-bit bounds widen to BIGINT."""
    return spark.read.parquet(path).select(
        F.col("start_ip_num").cast("bigint").alias("start_ip_num"),
        F.col("end_ip_num").cast("bigint").alias("end_ip_num"),
        "country_name")


def try_read_geo(spark: SparkSession, path: str) -> DataFrame | str:
    """The ranges, or why they cannot be had: a profile goes on without them."""
    try:
        return read_geo(spark, path)
    except AnalysisException as e:
        return str(e).splitlines()[0]

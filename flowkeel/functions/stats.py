"""Small statistical expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_bucket(x: Column, steps: int) -> Column:
    """An order-preserving bucket, `steps` per doubling of the magnitude."""
    d = x.cast("double")
    size = F.floor(F.log2(F.abs(d) + 1.0) * steps)
    return F.when(d < 0, -size).otherwise(size)


def robust_score(x: Column, median: Column, iqr: Column) -> Column:
    """`(x - median) / iqr` clipped to [-10, 10]; 0 where the spread vanishes."""
    clipped = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (x - median) / F.nullif(iqr, F.lit(0.0))))
    return F.when(F.abs(iqr) < 1e-12, F.lit(0.0)).otherwise(clipped)


def log1p_clamped(x: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), x.cast("double")))

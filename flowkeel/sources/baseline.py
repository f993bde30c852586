"""The baseline document as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowkeel.schema import BASELINE_DDL


def _unfit(column, dtype: T.DataType):
    """True if a NaN or infinity sits anywhere below `column`, else false or null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    if isinstance(dtype, T.StructType):
        parts = [_unfit(column[f.name], f.dataType) for f in dtype]
        parts = [F.coalesce(x, F.lit(False)) for x in parts if x is not None]
        return None if not parts else F.array_contains(F.array(*parts), True)
    if isinstance(dtype, T.MapType):
        return _unfit(F.map_values(column), T.ArrayType(dtype.valueType))
    if isinstance(dtype, T.ArrayType):
        if _unfit(F.lit(None), dtype.elementType) is None:
            return None
        return F.exists(column, lambda x: F.coalesce(_unfit(x, dtype.elementType), F.lit(False)))
    return None


def checked(doc: DataFrame) -> DataFrame:
    """Fails on NaN and infinities, which JSON cannot carry."""
    out = {}
    for f in doc.schema:
        bad = _unfit(F.col(f.name), f.dataType)
        if bad is not None:
            message = F.lit(f"{f.name} holds a value JSON cannot carry")
            out[f.name] = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message).cast(f.dataType)).otherwise(
                F.col(f.name))
    return doc.withColumns(out)


def write_baseline(doc: DataFrame, path: str) -> None:
    """Writes the one-row document as a single JSON file in folder `path`."""
    checked(doc).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Reads a document written here or by hand, indented or not."""
    return spark.read.schema(BASELINE_DDL).option("multiLine", True).json(path)


def profile_rows(doc: DataFrame) -> DataFrame:
    """`(metric, min, ..., iqr)` rows of the numerical profiles."""
    return doc.select(F.explode("numerical_profiles").alias("metric", "p")).select("metric", "p.*")


def _rare_path(path: str) -> str:
    return f"{path.rstrip('/')}-rare-sources"


def write_rare(rare: DataFrame, path: str) -> None:
    """Writes every rare source beside the document in folder `path`."""
    rare.select("src_ip").write.mode("overwrite").parquet(_rare_path(path))


def read_rare(spark: SparkSession, path: str) -> DataFrame:
    """`src_ip` rows of all rare sources that the profile in folder `path` found."""
    return spark.read.parquet(_rare_path(path))


def rare_sources(doc: DataFrame) -> DataFrame:
    """`src_ip` rows of the document's sample of rare sources, which is cut at its limit."""
    return doc.select(F.explode("categorical_baselines.rare_src_ips_sample").alias("src_ip"))

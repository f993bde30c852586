"""The store of conversation states: one folder for every load of captures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowkeel.schema import STATES_SCHEMA

LOAD = re.compile(r"[A-Za-z0-9_.\-]+")


def write_load(states: DataFrame, store: str, load: str) -> None:
    """Writes the states of one load, in place of an earlier one of this name; other loads stay as they are."""
    if not LOAD.fullmatch(load):
        raise ValueError(f"load: {load!r}")
    columns = [F.col(c).cast(STATES_SCHEMA[c].dataType).alias(c) for c in STATES_SCHEMA.names]
    states.select(*columns).write.mode("overwrite").parquet(f"{store}/load={load}")


def read_states(spark: SparkSession, store: str, loads: list[str] | None = None) -> DataFrame:
    """The states of all loads, or of the named ones, with the column `load`; a conversation may have one in each."""
    schema = T.StructType([*STATES_SCHEMA.fields, T.StructField("load", T.StringType())])
    states = spark.read.schema(schema).parquet(store)
    return states if loads is None else states.filter(F.col("load").isin(*loads))

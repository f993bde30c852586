"""Scores flow files as they arrive, with the batch operators.

Enrichment, scoring and flagging look at one flow at a time against a fixed
baseline, model and threshold, so a stream needs no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowkeel.operators.anomaly import flag_anomalies
from flowkeel.operators.autoencoder import Model
from flowkeel.operators.features import build_features
from flowkeel.params import FeatureParams
from flowkeel.schema import SPACED, FlowSchema
from flowkeel.sources.flows import canonical


def stream_flows(spark: SparkSession, folder: str, schema: FlowSchema = SPACED, time_unit: str = "us") -> DataFrame:
    """New flow Parquet in `folder`; its present files give the column types."""
    files = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    return canonical(files, schema, time_unit)


def score_stream(flows: DataFrame, model: Model, profile: DataFrame, rare: DataFrame, threshold: float,
                 params: FeatureParams = FeatureParams(), **kw) -> DataFrame:
    """Adds `recon_error` and `is_anomaly` to a stream of flows; `kw` goes to the rare-source lookup."""
    vectors = build_features(flows, profile, rare, params, **kw)
    return flag_anomalies(model.score(vectors).drop("features"), threshold=threshold)

"""The reconstruction model and the three-sigma rule as stages of a machine-learning pipeline.

`Pipeline(stages=[ReconstructionEstimator(epochs=5), SigmaEstimator()]).fit(table)` trains on `features`, scores,
and fixes the threshold; the fitted pipeline is saved, loaded in another session, and applied to other
flows. States are saved as rows, so that independent models of any number of shards fit.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml import Model as FittedStage
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame

from flowkeel.operators.anomaly import flag_anomalies, sigma_threshold
from flowkeel.operators.autoencoder import AdamState, Autoencoder, Model, Network, assign_shards
from flowkeel.params import TrainParams
from flowkeel.session import materialise

STATES_DDL, METRICS_DDL = "shard int, state array<double>", "tag string, step bigint, value double"


class TrainSettings(Params):
    """The training parameters as parameters of a stage; `shards` 0 leaves their number to the rows."""

    inputCol = Param(Params._dummy(), "inputCol", "vectors, as arrays of doubles", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "reconstruction error", TypeConverters.toString)
    hiddenDims = Param(Params._dummy(), "hiddenDims", "widths of the encoder's layers", TypeConverters.toListInt)
    latentDim = Param(Params._dummy(), "latentDim", "width of the latent vector", TypeConverters.toInt)
    batchSize = Param(Params._dummy(), "batchSize", "rows of a step", TypeConverters.toInt)
    epochs = Param(Params._dummy(), "epochs", "passes over the rows", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "rate of a step", TypeConverters.toFloat)
    sync = Param(Params._dummy(), "sync", "average or none", TypeConverters.toString)
    shards = Param(Params._dummy(), "shards", "shards of the rows", TypeConverters.toInt)
    rowsPerShard = Param(Params._dummy(), "rowsPerShard", "rows of a shard", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the first weights", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        p = TrainParams()
        self._setDefault(inputCol="features", outputCol="recon_error", hiddenDims=list(p.hidden_dims), latentDim=p.latent_dim,
                         batchSize=p.batch_size, epochs=p.epochs, learningRate=p.learning_rate, sync=p.sync, shards=0,
                         rowsPerShard=p.rows_per_shard, seed=p.seed)

    def train_params(self) -> TrainParams:
        get = self.getOrDefault
        return TrainParams(hidden_dims=tuple(get("hiddenDims")), latent_dim=get("latentDim"), batch_size=get("batchSize"),
                           epochs=get("epochs"), learning_rate=get("learningRate"), sync=get("sync"), shards=get("shards") or None,
                           rows_per_shard=get("rowsPerShard"), seed=get("seed"))

    def vectors(self, df: DataFrame) -> DataFrame:
        """`df` with its vectors under the name that training expects."""
        name = self.getOrDefault("inputCol")
        if name == "features":
            return df
        if "features" in df.columns:
            raise ValueError("a column `features` beside the vectors")
        return df.withColumnRenamed(name, "features")


class ReconstructionEstimator(Estimator, TrainSettings, DefaultParamsReadable, DefaultParamsWritable):
    """Trains the autoencoder. A column `shard` names the shard of each row; without it the row's hash does."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, hiddenDims=None, latentDim=None, batchSize=None, epochs=None,
                 learningRate=None, sync=None, shards=None, rowsPerShard=None, seed=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ReconstructionModel:
        p, table = self.train_params(), self.vectors(dataset)
        if p.sync == "none":
            table = materialise(table, "vectors")
            p = replace(p, shards=p.shards_for(table.count()))
        return self._copyValues(ReconstructionModel(Autoencoder(p).fit(table)))


class ReconstructionModel(FittedStage, TrainSettings, MLReadable, MLWritable):
    """Adds the reconstruction error. Independent models score the rows of their own shard, named by `shard` or by the
    hash of the row, which is that of training where the row has the same columns."""

    def __init__(self, model: Model | None = None):
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows, name = self.vectors(dataset), self.getOrDefault("inputCol")
        own = self.model.params.sync == "none" and "shard" not in rows.columns
        scored = self.model.score(assign_shards(rows, self.model.params.shards) if own else rows, self.getOrDefault("outputCol"))
        scored = scored.drop("shard") if own else scored
        return scored if name == "features" else scored.withColumnRenamed("features", name)

    def write(self) -> MLWriter:
        return ReconstructionWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ReconstructionReader()


class ReconstructionWriter(MLWriter):
    def __init__(self, stage: ReconstructionModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark, model = self.sparkSession, self.stage.model
        DefaultParamsWriter.saveMetadata(self.stage, path, spark, extraMetadata={
            "widths": list(model.network.widths), "trainedShards": model.params.shards or 0})
        states = model.states
        if states is None:
            states = spark.createDataFrame([(s, AdamState.start(w).flat().tolist()) for s, w in model.weights.items()], STATES_DDL)
        states.select("shard", "state").write.parquet(f"{path}/states")
        metrics = spark.createDataFrame([], METRICS_DDL) if model.metrics is None else model.metrics
        metrics.write.parquet(f"{path}/metrics")


class ReconstructionReader(MLReader):
    def load(self, path: str) -> ReconstructionModel:
        spark = self.sparkSession
        about = DefaultParamsReader.loadMetadata(path, spark)
        stage = ReconstructionModel()
        DefaultParamsReader.getAndSetParams(stage, about)
        stage._resetUid(about["uid"])
        params = replace(stage.train_params(), shards=about["trainedShards"] or None)
        states = spark.read.schema(STATES_DDL).parquet(f"{path}/states")
        metrics = spark.read.schema(METRICS_DDL).parquet(f"{path}/metrics")
        network = Network(tuple(about["widths"]))
        if params.sync == "none":
            stage.model = Model(network, None, params, metrics, states)
        else:
            weights = AdamState.unflat(np.array(states.filter("shard = 0").first()["state"])).weights
            stage.model = Model(network, {0: weights}, params, metrics)
        return stage


class SigmaSettings(Params):
    inputCol = Param(Params._dummy(), "inputCol", "score", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "whether the score is above the threshold", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "deviations above the mean", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCol="recon_error", outputCol="is_anomaly", k=3.0)


class SigmaEstimator(Estimator, SigmaSettings, DefaultParamsReadable, DefaultParamsWritable):
    """Fixes the threshold that the scores it is fitted to give, in one pass."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, k=None):
        super().__init__()
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SigmaModel:
        row = sigma_threshold(dataset, self.getOrDefault("inputCol"), self.getOrDefault("k")).first()
        stage = SigmaModel()
        if row["threshold"] is not None:
            stage._set(threshold=row["threshold"])
        return self._copyValues(stage)


class SigmaModel(FittedStage, SigmaSettings, DefaultParamsReadable, DefaultParamsWritable):
    """Flags scores strictly above the threshold; fitted to no scores at all it flags nothing."""

    threshold = Param(Params._dummy(), "threshold", "score above which a row is flagged", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cut = self.getOrDefault("threshold") if self.isDefined("threshold") else float("inf")
        out = self.getOrDefault("outputCol")
        flagged = flag_anomalies(dataset, self.getOrDefault("inputCol"), threshold=cut)
        return flagged if out == "is_anomaly" else flagged.withColumnRenamed("is_anomaly", out)

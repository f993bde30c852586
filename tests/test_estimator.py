"""Pipeline stages of the model and the threshold: fitted, saved, loaded, applied."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from flowkeel.operators.anomaly import flag_anomalies
from flowkeel.operators.autoencoder import Autoencoder, assign_shards
from flowkeel.operators.estimator import ReconstructionEstimator, ReconstructionModel, SigmaEstimator, SigmaModel
from flowkeel.params import TrainParams
from flowkeel.session import materialise
from helpers import rows_of

SMALL = dict(hiddenDims=[6, 4], latentDim=2, batchSize=16, epochs=2, learningRate=0.01, shards=3)
SAME = TrainParams(hidden_dims=(6, 4), latent_dim=2, batch_size=16, epochs=2, learning_rate=0.01, shards=3)


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(3).normal(size=(120, 5))
    return materialise(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, features array<double>"), "train")


def test_pipeline_equals_the_operators_and_survives_storage(spark, table, tmp_path):
    fitted = Pipeline(stages=[ReconstructionEstimator(**SMALL), SigmaEstimator(k=1.5)]).fit(table)
    expected = rows_of(flag_anomalies(Autoencoder(SAME).fit(table).score(table), k=1.5))
    assert rows_of(fitted.transform(table)) == expected and any(r[-1] for r in expected)
    fitted.save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert rows_of(loaded.transform(table)) == expected
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
    assert rows_of(loaded.stages[0].model.metrics) == rows_of(fitted.stages[0].model.metrics)
    few = table.filter("id < 5")
    assert rows_of(loaded.transform(few)) == [r for r in expected if r[0] < 5]  # the threshold is the one fitted


def test_loading_in_a_session_of_its_own(spark, table, tmp_path):
    stage = ReconstructionEstimator(**SMALL).fit(table)
    stage.write().overwrite().save(str(tmp_path / "one"))
    stage.write().overwrite().save(str(tmp_path / "one"))
    other = spark.newSession()
    loaded = ReconstructionModel.read().session(other).load(str(tmp_path / "one"))
    assert rows_of(loaded.transform(other.read.parquet(*table.inputFiles()))) == rows_of(stage.transform(table))


def test_independent_models_are_stored_as_rows(spark, table, tmp_path):
    stage = ReconstructionEstimator(sync="none", **SMALL).fit(table)
    scored = rows_of(stage.transform(table))
    assert len({round(r[-1], 12) for r in scored}) > 100 and len(scored) == 120
    direct = Autoencoder(TrainParams(**{**vars(SAME), "sync": "none"})).fit(assign_shards(table, 3))
    assert scored == rows_of(direct.score(assign_shards(table, 3)).drop("shard"))
    stage.save(str(tmp_path / "models"))
    assert spark.read.parquet(str(tmp_path / "models/states")).count() == 3
    assert rows_of(ReconstructionModel.load(str(tmp_path / "models")).transform(table)) == scored


def test_names_of_columns_and_saved_settings(spark, table, tmp_path):
    named = table.withColumnRenamed("features", "v")
    est = ReconstructionEstimator(inputCol="v", outputCol="err", **SMALL)
    est.save(str(tmp_path / "est"))
    again = ReconstructionEstimator.load(str(tmp_path / "est"))
    assert again.train_params() == est.train_params() == SAME
    out = again.fit(named).transform(named)
    assert out.columns == ["id", "v", "err"]
    flags = SigmaEstimator(inputCol="err", outputCol="odd").fit(out).transform(out)
    assert flags.columns == ["id", "v", "err", "odd"]
    with pytest.raises(ValueError, match="features"):
        est.fit(named.withColumn("features", F.col("v")))


def test_threshold_without_scores_flags_nothing(spark, tmp_path):
    scores = spark.createDataFrame([(1.0,), (None,)], "recon_error double")
    none = SigmaEstimator().fit(scores.limit(0))
    none.save(str(tmp_path / "none"))
    assert rows_of(SigmaModel.load(str(tmp_path / "none")).transform(scores)) == [(1.0, False), (None, False)]

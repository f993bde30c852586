"""Training job: flows and a baseline to scores, a threshold and flagged flows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame

from flowkeel.operators.anomaly import anomaly_summary, error_histogram, flag_anomalies
from flowkeel.operators.autoencoder import Model, assign_shards, get_model, row_order
from flowkeel.operators.features import build_features, feature_names, rare_feature, vector_inputs
from flowkeel.params import FeatureParams, TrainParams
from flowkeel.session import materialise
from flowkeel.sources.metrics import append_metrics, scoring_metrics


@dataclass
class TrainingRun:
    """A trained model and the vectors it scores. Scores are computed, and stored, when first asked for."""

    model: Model
    table: DataFrame

    @cached_property
    def scored(self) -> DataFrame:
        return materialise(self.model.score(self.table).drop("features"), "scores")

    @property
    def flagged(self) -> DataFrame:
        return flag_anomalies(self.scored)

    @property
    def summary(self) -> DataFrame:
        return anomaly_summary(self.scored)


def train_and_flag(flows: DataFrame, profile: DataFrame, rare: DataFrame, features: FeatureParams = FeatureParams(),
                   train: TrainParams = TrainParams(), store: bool = True) -> TrainingRun:
    """Enriches, trains, scores and flags `flows`.

    `profile` and `rare` come from a baseline document or straight from the
    profile operators. Flows with their rare flag and scores are written to the shared folder, so
    neither epochs nor the threshold repeat the work before them; vectors are computed where they
    are read. Without `store` the flagged flows are not written, for runs that only train.
    """
    marked = rare_feature(flows, rare) if features.use_rare_src_ip else flows
    marked = materialise(marked, "marked") if store else marked
    train = replace(train, shards=train.shards_for(flows.count()))
    own, source = [*flows.columns, "features"], vector_inputs(features)

    def build(rows: DataFrame) -> DataFrame:
        return build_features(rows, profile, None, features)

    table = build(marked)
    dealt = assign_shards(table, train.shards, own).withColumn("place", row_order(table, own))
    model = get_model(train).fit(dealt, len(feature_names(features)), source, build)
    table = table.select(*own)
    return TrainingRun(model, table if train.sync == "average" else assign_shards(table, train.shards))


def write_run(run: TrainingRun, out_dir: str, run_id: str, bins: int = 60) -> None:
    """Flagged flows and the run's metrics."""
    run.flagged.write.mode("overwrite").parquet(f"{out_dir}/flagged/run={run_id}")
    append_metrics(run.model.metrics, f"{out_dir}/metrics", run_id)
    append_metrics(scoring_metrics(run.summary, error_histogram(run.scored, bins=bins)),
                   f"{out_dir}/metrics", run_id)

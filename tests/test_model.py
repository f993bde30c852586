"""Training, scoring and the three-sigma rule against plain NumPy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkeel.operators import anomaly
from flowkeel.operators import autoencoder
from flowkeel.operators.autoencoder import (AdamState, Autoencoder, Network, ShardTrainer, assign_shards, deal, get_model, slots,
                                            row_order)
from flowkeel.operators.features import build_features, rare_feature, vector_inputs
from flowkeel.params import FeatureParams, TrainParams
from flowkeel.plans.training import train_and_flag, write_run
from flowkeel.operators.profile import numeric_profile, rare_values
from flowkeel.session import materialise, shared_dir
from helpers import plan_of

SMALL = dict(hidden_dims=(6, 4), latent_dim=2, batch_size=16, epochs=3, learning_rate=0.01)


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(0)
    return rng.normal(size=(203, 5)) @ rng.normal(size=(5, 5))


@pytest.fixture(scope="module")
def table(spark, matrix):
    rows = [(i, r.tolist()) for i, r in enumerate(matrix)]
    return materialise(spark.createDataFrame(rows, "id int, features array<double>").repartitionByRange(4, "id")
                       .sortWithinPartitions("id"), "train")


def test_layers():
    n = Network.symmetric(12, (32, 16), 8)
    assert n.widths == (12, 32, 16, 8, 16, 32, 12) and n.size == 2164 and n.bottleneck == 2


def test_forward_has_relu_only_on_hidden_layers():
    n = Network.symmetric(3, (4,), 2)
    flat = n.initial(1)
    x = np.random.default_rng(2).normal(size=(7, 3))
    (w1, b1), (w2, b2), (w3, b3), (w4, b4) = n.layers(flat)
    latent = np.maximum(x @ w1 + b1, 0) @ w2 + b2
    want = np.maximum(latent @ w3 + b3, 0) @ w4 + b4
    assert np.allclose(n.activations(flat, x)[-1], want)
    assert np.allclose(n.errors(flat, x), ((want - x) ** 2).mean(axis=1))


def test_gradient():
    n = Network.symmetric(4, (5, 3), 2)
    flat, x = n.initial(3), np.random.default_rng(4).normal(size=(9, 4))
    loss, grad = n.gradient(flat, x)
    assert np.isclose(loss, n.errors(flat, x).mean())
    for i in range(0, n.size, 7):
        step = np.zeros(n.size)
        step[i] = 1e-6
        numeric = (n.errors(flat + step, x).mean() - n.errors(flat - step, x).mean()) / 2e-6
        assert np.isclose(grad[i], numeric, atol=1e-6)


def test_adam_first_step_is_the_rate():
    s = AdamState.start(np.array([1.0, -1.0]))
    s.step(np.array([3.0, -0.2]), 0.01)
    assert np.allclose(s.weights, [0.99, -0.99])
    assert np.allclose(AdamState.unflat(s.flat()).flat(), s.flat())


def test_batches_cross_block_borders():
    n, p = Network.symmetric(2, (2,), 1), TrainParams(batch_size=4)
    whole, pieces = (ShardTrainer(n, AdamState.start(n.initial(0)), p) for _ in range(2))
    x = np.random.default_rng(1).normal(size=(11, 2))
    whole.push(x)
    for part in (x[:3], x[3:4], x[4:10], x[10:]):
        pieces.push(part)
    whole.finish(), pieces.finish()
    assert len(whole.losses) == 3 and whole.losses == pieces.losses and pieces.rows == 11


def single_process(matrix, p):
    """Mini-batch Adam in row order, state kept over epochs."""
    n = Network.symmetric(matrix.shape[1], p.hidden_dims, p.latent_dim)
    state, losses = AdamState.start(n.initial(p.seed)), []
    for _ in range(p.epochs):
        batches = []
        for at in range(0, len(matrix), p.batch_size):
            loss, grad = n.gradient(state.weights, matrix[at:at + p.batch_size])
            state.step(grad, p.learning_rate)
            batches.append(loss)
        losses.append(batches)
    return n, state.weights, losses


def members(table, shards):
    """Ids of each shard's rows in the order in which they are trained."""
    rows = assign_shards(table, shards).withColumn("place", row_order(table)).collect()
    out = {s: [] for s in range(shards)}
    for r in sorted(rows, key=lambda r: (r["place"], r["features"])):
        out[r["shard"]].append(r["id"])
    return out


def test_one_shard_equals_single_process(table, matrix):
    p = TrainParams(shards=1, **SMALL)
    model = Autoencoder(p).fit(table)
    order = members(table, 1)[0]
    n, weights, losses = single_process(matrix[order], p)
    assert np.allclose(model.weights[0], weights, atol=1e-12)
    metrics = {(r["tag"], r["step"]): r["value"] for r in model.metrics.collect()}
    for e, batch in enumerate(losses):
        assert np.isclose(metrics["Training/Epoch_Loss", e], np.mean(batch))
        for b, loss in enumerate(batch):
            assert np.isclose(metrics["Training/Batch_Loss", e * len(batch) + b], loss)
    assert len(metrics) == p.epochs * (1 + len(losses[0]))
    scores = {r["id"]: r["recon_error"] for r in model.score(table).collect()}
    assert np.allclose([scores[i] for i in range(len(matrix))], n.errors(weights, matrix))


def test_averaging_learns_and_repeats(table):
    p = TrainParams(**{**SMALL, "epochs": 6})
    first, second = Autoencoder(p).fit(table), Autoencoder(p).fit(table)
    assert np.allclose(first.weights[0], second.weights[0])
    losses = [r["value"] for r in first.metrics.filter("tag = 'Training/Epoch_Loss'").orderBy("step").collect()]
    assert losses[-1] < losses[0]


def test_average_is_weighted_by_rows(table, matrix):
    p = TrainParams(**{**SMALL, "epochs": 1, "shards": 3})
    want = 0
    for ids in members(table, 3).values():
        _, w, _ = single_process(matrix[ids], p)
        want = want + w * len(ids) / len(matrix)
    assert np.allclose(Autoencoder(p).fit(table).weights[0], want)


@pytest.mark.parametrize("sync", ["average", "none"])
def test_models_do_not_depend_on_files(spark, table, tmp_path, sync):
    p = TrainParams(**{**SMALL, "epochs": 2, "shards": 4, "sync": sync})
    models, counts = [], []
    for files in (1, 3, 8):
        path = f"{tmp_path}/{sync}-{files}"
        table.repartition(files, F.rand(files)).write.parquet(path)
        model = Autoencoder(p).fit(spark.read.parquet(path))
        models.append(model.weights)
        counts.append(model.metrics.filter("tag = 'Training/Batch_Loss'").count())
    assert all(len(m) == (4 if sync == "none" else 1) for m in models)
    for other in models[1:]:
        assert all(np.allclose(models[0][s], other[s], atol=1e-9) for s in models[0])
    assert counts[0] > 0 and len(set(counts)) == 1


def test_independent_shards(table, matrix):
    p = TrainParams(sync="none", **{**SMALL, "shards": 5})
    sharded = materialise(assign_shards(table, 5), "sharded")
    model = Autoencoder(p).fit(sharded)
    assert len(model.weights) == 5
    scored = model.score(sharded)
    assert scored.columns == [*sharded.columns, "recon_error"]
    scores = {r["id"]: r["recon_error"] for r in scored.collect()}
    assert len(scores) == len(matrix)
    for shard, ids in members(table, 5).items():
        n, weights, _ = single_process(matrix[ids], p)
        assert np.allclose(model.weights[shard], weights)
        assert np.allclose([scores[i] for i in ids], n.errors(weights, matrix[ids]))


def test_epochs_read_buckets_without_exchange_or_sort(spark, table, matrix):
    p = TrainParams(**{**SMALL, "shards": 6})
    rows = deal(assign_shards(table, 6), 6)
    n = Network.symmetric(matrix.shape[1], p.hidden_dims, p.latent_dim)
    epoch = Autoencoder(p).epoch(rows, n, {}, AdamState.start(n.initial(0)).flat())
    plan = plan_of(epoch)
    below = plan[plan.index("MapInArrow"):]
    assert "Bucketed: true" in below and "Exchange" not in below and "Sort" not in below
    done = {r["shard"]: r["n"] for r in epoch.collect()}
    want = {s: len(ids) for s, ids in members(table, 6).items() if ids}
    assert done == want and len(rows.inputFiles()) == len(want)


def test_vectors_are_stored_in_blocks_and_built_where_they_are_trained(spark, flows):
    """Only a vector's sources are shuffled, and the stored blocks hold each shard's vectors in its order."""
    rows = numeric_profile(flows)
    marked = materialise(rare_feature(flows, rare_values(flows, "src_ip")), "marked")
    own, source = [*flows.columns, "features"], vector_inputs(FeatureParams())
    whole = build_features(marked, rows, None)
    dealt = assign_shards(whole, 3, own).withColumn("place", row_order(whole, own))
    plans = []
    blocks = deal(dealt, 3, source, lambda df: plans.append(df) or build_features(df, rows, None))
    assert set(plans[0].columns) == {"shard", "place", *source} and "features" not in source
    direct = materialise(build_features(flows, rows, rare_values(flows, "src_ip")), "direct")
    want = assign_shards(direct, 3).withColumn("place", row_order(direct)).orderBy("shard", "place").collect()
    stored = blocks.orderBy("shard", "part").collect()
    assert len(stored) < len(want) / 100
    for shard in range(3):
        own_blocks = [b for b in stored if b["shard"] == shard]
        got = autoencoder.unpacked([b["n"] for b in own_blocks], [b["vectors"] for b in own_blocks])
        assert got.tolist() == [r["features"] for r in want if r["shard"] == shard]


def test_runs_that_only_train_store_no_scores(spark, flows):
    profile, rare = numeric_profile(flows), rare_values(flows, "src_ip")
    root = shared_dir(spark)
    before = set(os.listdir(root))
    run = train_and_flag(flows, profile, rare, train=TrainParams(epochs=1), store=False)
    assert run.model.metrics.count() > 1
    new = {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before}
    assert "training-rows" in new and not new & {"features", "marked", "scores"}
    assert run.flagged.count() == flows.count()


@pytest.mark.parametrize("shards", [1, 2, 13, 300])
def test_slots_fill_every_bucket_once(spark, shards):
    got = [(r["shard"], r["slot"]) for r in slots(spark, shards).collect()]
    assert sorted(s for s, _ in got) == list(range(shards)) and len({k for _, k in got}) == shards


def test_states_are_sent_in_parts(spark, table, monkeypatch):
    p = TrainParams(sync="none", **{**SMALL, "shards": 7})
    whole = Autoencoder(p).fit(table).weights
    monkeypatch.setattr(autoencoder, "SENT_STATES", 3)
    parts = Autoencoder(p).fit(table).weights
    assert len(parts) == 7 and all(np.allclose(whole[s], parts[s]) for s in whole)


def test_rows_are_scored_where_they_are(spark, table, monkeypatch):
    """Independent models score without a shuffle of the rows, and alike where they are too many for that."""
    p = TrainParams(sync="none", **{**SMALL, "shards": 7})
    dealt = assign_shards(table, 7)
    model = Autoencoder(p).fit(dealt)
    scored = model.score(dealt)
    assert "Exchange" not in plan_of(scored)
    here = {tuple(r["features"]): r["recon_error"] for r in scored.collect()}
    monkeypatch.setattr(autoencoder, "SENT_STATES", 3)
    sent = model.score(dealt)
    assert "Exchange" in plan_of(sent)
    assert {tuple(r["features"]): r["recon_error"] for r in sent.collect()} == pytest.approx(here)


def test_number_of_shards_follows_the_rows():
    assert TrainParams().shards_for(0) == TrainParams().shards_for(10**6) == 8
    assert TrainParams().shards_for(100_000_001) == 51 and TrainParams(shards=3).shards_for(10**9) == 3
    with pytest.raises(ValueError, match="shards"):
        TrainParams(shards=0)


def test_more_shards_than_rows(spark):
    few = materialise(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 0.5])], "id int, features array<double>"), "few")
    p = TrainParams(sync="none", **{**SMALL, "shards": 7})
    assert len(Autoencoder(p).fit(few).weights) == 7
    both = Autoencoder(TrainParams(**{**SMALL, "shards": 7})).fit(few)
    assert np.isfinite(both.weights[0]).all()


def test_factory():
    assert isinstance(get_model(TrainParams()), Autoencoder)
    with pytest.raises(ValueError, match="no model of type 'vae'"):
        get_model(TrainParams(model_type="vae"))
    assert TrainParams.from_config({"batch_size": 10}).hidden_dims == (16, 8)
    assert TrainParams.from_config({"batch_size": 10}).latent_dim == 4
    with pytest.raises(ValueError):
        TrainParams(sync="sometimes")


def scored(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "recon_error double")


def test_threshold_and_flags(spark):
    values = [1.0] * 20 + [50.0]
    row = anomaly.sigma_threshold(scored(spark, *values)).first()
    assert np.isclose(row["threshold"], np.mean(values) + 3 * np.std(values)) and row["records"] == 21
    flagged = anomaly.flag_anomalies(scored(spark, *values)).filter("is_anomaly").collect()
    assert [r["recon_error"] for r in flagged] == [50.0]
    s = anomaly.anomaly_summary(scored(spark, *values)).first()
    assert (s["records"], s["anomalies"], s["max_error"]) == (21, 1, 50.0)


def test_equal_scores_are_never_flagged(spark):
    df = scored(spark, *[2.0] * 9)
    assert anomaly.sigma_threshold(df).first()["threshold"] == 2.0
    assert anomaly.flag_anomalies(df).filter("is_anomaly").count() == 0


def test_no_scores(spark):
    df = scored(spark, 1.0).limit(0)
    s = anomaly.anomaly_summary(df).first()
    assert (s["records"], s["threshold"], s["anomalies"], s["max_error"]) == (0, None, 0, 0.0)
    assert anomaly.flag_anomalies(df).count() == 0


def test_fixed_threshold(spark):
    assert anomaly.flag_anomalies(scored(spark, 1.0, 2.0, 3.0), threshold=2.0).filter("is_anomaly").count() == 1


def test_whole_job(spark, flows, tmp_path):
    run = train_and_flag(flows, numeric_profile(flows), rare_values(flows, "src_ip"),
                         train=TrainParams(epochs=2))
    assert run.flagged.count() == flows.count()
    s = run.summary.first()
    assert s["records"] == flows.count() and s["anomalies"] == run.flagged.filter("is_anomaly").count()
    write_run(run, str(tmp_path), "r1")
    write_run(run, str(tmp_path), "r2")
    tags = {(r["run_id"], r["tag"]) for r in spark.read.parquet(f"{tmp_path}/metrics").collect()}
    assert len(tags) == 2 * 5
    assert spark.read.parquet(f"{tmp_path}/flagged").count() == 2 * flows.count()


def test_python_only_where_needed(table):
    model = Autoencoder(TrainParams(**{**SMALL, "epochs": 1})).fit(table)
    assert plan_of(model.score(table)).count("ArrowEvalPython") == 1
    assert "Python" not in plan_of(anomaly.flag_anomalies(materialise(model.score(table), "s")))

"""Reconstruction model: local Adam on shards, averaged by Spark.

A row's shard follows from the hash of the row, and its place in the shard from a second
hash, so a result depends on the data and the number of shards and never on files, splits
or row order. The rows are shuffled once: their vectors are stored with a bucket for each shard, in
the shard's order and in blocks that are read as they are. An epoch then is one scan without an
exchange or a sort: a task reads a bucket from its first block to its last and streams it through
mini-batch Adam, starting from a state that is sent to all tasks, and Spark averages the shards'
states by row count. With one shard this is plain mini-batch training in that order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkeel.params import TrainParams
from flowkeel.session import bucketed, fresh_path, ship_package

# Adam's customary constants.
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8

# Metric tags.
EPOCH_LOSS, BATCH_LOSS = "Training/Epoch_Loss", "Training/Batch_Loss"

# Independent shards whose states are sent to tasks together.
SENT_STATES = 1024

# Size of a stored block of vectors, small since readers hold thousands of rows at a time.
BLOCK_BYTES = 16 << 10
# Blocks that are handed to training together.
PUSHED_BLOCKS = 64

BLOCK_SCHEMA = "shard int, part bigint, n int, vectors binary"
STATE_SCHEMA = "shard int, n bigint, state array<double>, loss double, batches bigint, losses array<double>"


@dataclass(frozen=True)
class Network:
    """Layer widths of a symmetric autoencoder over one flat weight vector."""

    widths: tuple[int, ...]

    @classmethod
    def symmetric(cls, input_dim: int, hidden: tuple[int, ...], latent: int) -> Network:
        return cls((input_dim, *hidden, latent, *hidden[::-1], input_dim))

    @property
    def bottleneck(self) -> int:
        """Index of the layer that yields the latent vector."""
        return (len(self.widths) - 1) // 2 - 1

    @property
    def size(self) -> int:
        return sum(i * o + o for i, o in zip(self.widths, self.widths[1:]))

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for i, o in zip(self.widths, self.widths[1:]):
            out.append((flat[at:at + i * o].reshape(i, o), flat[at + i * o:at + i * o + o]))
            at += i * o + o
        return out

    def initial(self, seed: int) -> np.ndarray:
        """Uniform within 1/sqrt(fan in), weights and offsets alike."""
        rng = np.random.default_rng(seed)
        parts = []
        for i, o in zip(self.widths, self.widths[1:]):
            parts.append(rng.uniform(-1, 1, i * o + o) / np.sqrt(i))
        return np.concatenate(parts)

    def _linear(self, layer: int) -> bool:
        return layer in (self.bottleneck, len(self.widths) - 2)

    def activations(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for k, (w, b) in enumerate(self.layers(flat)):
            z = acts[-1] @ w
            z += b
            acts.append(z if self._linear(k) else np.maximum(z, 0.0, out=z))
        return acts

    def errors(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Mean squared error per row."""
        return ((self.activations(flat, x)[-1] - x) ** 2).mean(axis=1)

    def gradient(self, flat: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean squared error over all elements, and its gradient."""
        acts = self.activations(flat, x)
        weights = [w for w, _ in self.layers(flat)]
        diff = acts[-1] - x
        grad = np.empty(self.size)
        slots = self.layers(grad)
        delta = 2.0 * diff / diff.size
        for k in range(len(slots) - 1, -1, -1):
            if not self._linear(k):
                delta *= acts[k + 1] > 0
            gw, gb = slots[k]
            gw[:] = acts[k].T @ delta
            gb[:] = delta.sum(axis=0)
            if k:
                delta = delta @ weights[k].T
        return float((diff ** 2).mean()), grad


@dataclass
class AdamState:
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    @classmethod
    def start(cls, weights: np.ndarray) -> AdamState:
        return cls(weights.copy(), np.zeros_like(weights), np.zeros_like(weights))

    def step(self, grad: np.ndarray, lr: float) -> None:
        self.steps += 1
        self.first += (1 - BETA1) * (grad - self.first)
        self.second += (1 - BETA2) * (grad * grad - self.second)
        m = self.first / (1 - BETA1 ** self.steps)
        v = self.second / (1 - BETA2 ** self.steps)
        self.weights -= lr * m / (np.sqrt(v) + EPS)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights, self.first, self.second, [self.steps]])

    @classmethod
    def unflat(cls, values: np.ndarray) -> AdamState:
        size = (len(values) - 1) // 3
        return cls(values[:size].copy(), values[size:2 * size].copy(),
                   values[2 * size:3 * size].copy(), float(values[-1]))


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column of equal-length vectors as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class ShardTrainer:
    """Feeds blocks of rows to Adam in batches of a fixed size; the last one is short."""

    def __init__(self, network: Network, state: AdamState, params: TrainParams):
        self.network, self.state, self.params = network, state, params
        self.rest: np.ndarray | None = None
        self.rows = 0
        self.losses: list[float] = []

    def _step(self, batch: np.ndarray) -> None:
        loss, grad = self.network.gradient(self.state.weights, batch)
        self.state.step(grad, self.params.learning_rate)
        self.losses.append(loss)

    def push(self, block: np.ndarray) -> None:
        self.rows += len(block)
        rows = block if self.rest is None else np.concatenate([self.rest, block])
        size = self.params.batch_size
        whole = len(rows) // size * size
        for at in range(0, whole, size):
            self._step(rows[at:at + size])
        self.rest = rows[whole:] if whole < len(rows) else None

    def finish(self) -> None:
        if self.rest is not None:
            self._step(self.rest)
            self.rest = None


class Model:
    """Trained weights: one vector, or one per shard if the shards were not synchronised.

    `states` has the independent models as rows (shard, state); `weights` collects
    them, of as many as are sent to tasks together: those score the rows where they are. Of more
    shards, each is sent its own as a row.
    """

    def __init__(self, network: Network, weights: dict[int, np.ndarray] | None, params: TrainParams,
                 metrics: DataFrame | None = None, states: DataFrame | None = None):
        self.network, self.params, self.metrics, self.states = network, params, metrics, states
        self._weights, self._shared = weights, None

    @property
    def weights(self) -> dict[int, np.ndarray]:
        if self._weights is None:
            own = self.states.select("shard", F.slice("state", 1, self.network.size).alias("weights"))
            self._weights = {r["shard"]: np.array(r["weights"]) for r in own.collect()}
        return self._weights

    def score(self, df: DataFrame, column: str = "recon_error") -> DataFrame:
        """Adds the mean squared reconstruction error of `features`."""
        ship_package(df.sparkSession)
        network = self.network
        if self.params.sync == "none" and self.params.shards > SENT_STATES:
            return self._score_shards(df, column)
        if self._shared is None:
            self._shared = df.sparkSession.sparkContext.broadcast(self.weights if self.params.sync == "none" else self.weights[0])
        shared = self._shared

        @F.arrow_udf("double")
        def own_error(features: pa.Array, shard: pa.Array) -> pa.Array:
            rows, shards = as_matrix(features), shard.to_numpy(zero_copy_only=False)
            errors = np.empty(len(rows))
            for s in np.unique(shards).tolist():
                errors[shards == s] = network.errors(shared.value[int(s)], rows[shards == s])
            return pa.array(errors)

        @F.arrow_udf("double")
        def error(features: pa.Array) -> pa.Array:
            return pa.array(network.errors(shared.value, as_matrix(features)))

        return df.withColumn(column, own_error("features", "shard") if self.params.sync == "none" else error("features"))

    def _score_shards(self, df: DataFrame, column: str) -> DataFrame:
        network, names = self.network, df.columns
        rows = df.select(F.col("shard").alias("_shard"), F.lit(1).alias("_kind"), F.lit(None).cast("array<double>").alias("_state"),
                         F.struct(*names).alias("_row"))
        states = self.states.select(F.col("shard").alias("_shard"), F.lit(0).alias("_kind"), F.col("state").alias("_state"),
                                    F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights: dict[int, np.ndarray] = {}
            for b in batches:
                kind, shards = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 0))
                for i in np.flatnonzero(kind == 0).tolist():
                    weights = {int(shards[i]): AdamState.unflat(np.array(b.column(2)[i].as_py())).weights}
                flows = np.flatnonzero(kind == 1)
                if not len(flows):
                    continue
                for s in np.unique(shards[flows]).tolist():
                    own = b.column(3).take(pa.array(flows[shards[flows] == s]))
                    columns = own.flatten()
                    errors = network.errors(weights[int(s)], as_matrix(columns[names.index("features")]))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(errors)], names=[*names, column])

        dealt = by_shard(states.unionByName(rows), self.params.shards, "_shard", "_kind")
        out = df.withColumn(column, F.lit(0.0)).schema
        return dealt.mapInArrow(run, out)


def by_shard(rows: DataFrame, shards: int, shard: str, *order: str) -> DataFrame:
    """Whole shards in tasks of their own, in order."""
    return rows.repartitionById(shards, F.col(shard)).sortWithinPartitions(shard, *order)


def slots(spark: SparkSession, shards: int) -> DataFrame:
    """For each shard a number whose bucket, of as many buckets as shards, is the shard's own."""
    tried = spark.range(math.ceil(shards * (math.log(shards) + 25))).select(F.col("id").cast("int").alias("slot"))
    return tried.groupBy(F.pmod(F.hash("slot"), F.lit(shards)).alias("shard")).agg(F.min("slot").alias("slot"))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, features) as blocks of one shard's vectors, column by column, numbered in the task."""
    parts = count()
    for b in batches:
        shards, vectors = b.column(0).to_numpy(zero_copy_only=False), as_matrix(b.column(1))
        most = max(1, BLOCK_BYTES // (8 * max(1, vectors.shape[1])))
        cuts = [0, *(np.flatnonzero(np.diff(shards) != 0) + 1).tolist(), len(b)]
        spans = [(at, min(at + most, hi)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for at in range(lo, hi, most)]
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([int(shards[lo]) for lo, _ in spans], pa.int32()), "part": pa.array([next(parts) for _ in spans], pa.int64()),
            "n": pa.array([hi - lo for lo, hi in spans], pa.int32()), "vectors": pa.array([vectors[lo:hi].T.tobytes() for lo, hi in spans], pa.binary())})


def unpacked(n: list[int], vectors: list[bytes]) -> np.ndarray:
    """The rows of some blocks."""
    return np.concatenate([np.frombuffer(v).reshape(-1, k).T for k, v in zip(n, vectors, strict=True)])


def deal(table: DataFrame, shards: int, inputs: Sequence[str] = ("features",), build: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The vectors in buckets, one for each shard, each one file of blocks in the order in which they are trained.

    `build` adds `features` to rows of `inputs` once these are where they belong, which shuffles less than the vectors.
    A column `place` orders a shard's rows; without it the hash of the row does.
    """
    ship_package(table.sparkSession)
    place = F.col("place") if "place" in table.columns else row_order(table)
    ordered = by_shard(table.select("shard", place.alias("place"), *inputs), shards, "shard", "place")
    vectors = ordered if build is None else build(ordered)
    blocks = vectors.select("shard", "features").mapInArrow(packed, BLOCK_SCHEMA)
    named = blocks.join(F.broadcast(slots(table.sparkSession, shards)), "shard")
    return bucketed(named, "training-rows", shards, "slot", "part", compression="zstd")


class Autoencoder:
    """Trains a `Model` on a table with `features ARRAY<DOUBLE>`.

    The table is read once to number its rows and once to deal them to shards. A `shard INT`
    column from 0 below the number of shards names the shard of each row, a `place` its place there;
    without them its hashes do. `inputs` and `build` are those of `deal`.
    """

    def __init__(self, params: TrainParams = TrainParams()):
        self.params = params

    def fit(self, table: DataFrame, input_dim: int | None = None, inputs: Sequence[str] = ("features",),
            build: Callable[[DataFrame], DataFrame] | None = None) -> Model:
        spark = table.sparkSession
        ship_package(spark)
        if input_dim is None:
            first = table.select(F.size("features").alias("w")).first()
            if first is None:
                raise ValueError("no rows to train on")
            input_dim = first["w"]
        shards = self.params.shards or self.params.shards_for(table.count())
        p = replace(self.params, shards=shards)
        network = Network.symmetric(input_dim, p.hidden_dims, p.latent_dim)
        start = AdamState.start(network.initial(p.seed)).flat()
        rows = deal(table if "shard" in table.columns else assign_shards(table, shards), shards, inputs, build)

        root = fresh_path(spark, "training")
        state, done = start, None
        for epoch in range(p.epochs):
            path = f"{root}/epoch={epoch}"
            if p.sync == "average":
                self.epoch(rows, network, {}, state).write.parquet(path)
            else:
                for lo in range(0, shards, SENT_STATES):
                    some = F.col("shard").between(lo, min(lo + SENT_STATES, shards) - 1)
                    known = {} if done is None else {r["shard"]: np.array(r["state"]) for r in done.filter(some).select("shard", "state").collect()}
                    part = rows if shards <= SENT_STATES else rows.join(
                        F.broadcast(slots(spark, shards).filter(some).select("slot")), "slot", "left_semi")
                    self.epoch(part, network, known, start).write.mode("append").parquet(path)
            done = spark.read.parquet(path)
            if p.sync == "average":
                mean = average(done).first()["state"]
                state = state if mean is None else np.array(mean)
        metrics = training_metrics(spark, root, p.epochs)
        if p.sync == "average":
            return Model(network, {0: AdamState.unflat(state).weights}, p, metrics)
        every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
        untrained = F.array(*[F.lit(float(v)) for v in start]) if done is None else spark.createDataFrame([(start.tolist(),)], "state array<double>").scalar()
        states = every.withColumn("state", untrained) if done is None else every.join(done.select("shard", "state"), "shard", "left").withColumn(
            "state", F.coalesce("state", untrained))
        return Model(network, None, p, metrics, states)

    def epoch(self, rows: DataFrame, network: Network, known: dict[int, np.ndarray], start: np.ndarray) -> DataFrame:
        """Each shard's state after one pass over its rows, from its state in `known` or else `start`."""
        p, shared = self.params, rows.sparkSession.sparkContext.broadcast((known, start))

        def row(shard: int, trainer: ShardTrainer) -> pa.RecordBatch:
            trainer.finish()
            losses = trainer.losses
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "n": pa.array([trainer.rows], pa.int64()),
                "state": pa.array([trainer.state.flat().tolist()], pa.list_(pa.float64())),
                "loss": pa.array([float(np.mean(losses)) if losses else None], pa.float64()),
                "batches": pa.array([len(losses)], pa.int64()),
                "losses": pa.array([losses if shard == 0 else []], pa.list_(pa.float64()))})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states, first = shared.value
            shard, trainer = None, None
            for b in batches:
                shards = b.column(0).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(shards) != 0) + 1).tolist(), len(b)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if hi > lo and int(shards[lo]) != shard:
                        if trainer is not None:
                            yield row(shard, trainer)
                        shard = int(shards[lo])
                        trainer = ShardTrainer(network, AdamState.unflat(states.get(shard, first)), p)
                    for at in range(lo, hi, PUSHED_BLOCKS):
                        some = slice(at, min(at + PUSHED_BLOCKS, hi))
                        trainer.push(unpacked(b.column(1)[some].to_pylist(), b.column(2)[some].to_pylist()))
            if trainer is not None:
                yield row(shard, trainer)

        # Spark reads bucket by bucket if the bucket's column is read and a grouping, here of the shards' few rows, is above.
        names = [c.split()[0] for c in STATE_SCHEMA.split(", ")][1:]
        return rows.select("shard", "n", "vectors", "slot").mapInArrow(run, STATE_SCHEMA).groupBy("shard").agg(*[F.first(c).alias(c) for c in names])


def average(done: DataFrame) -> DataFrame:
    """The shards' states averaged by their rows, as one array."""
    parts = done.filter("n > 0").select("n", F.posexplode("state").alias("idx", "value"))
    mean = parts.groupBy("idx").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return mean.agg(F.nullif(F.transform(pairs, lambda e: e["value"]), F.array().cast("array<double>")).alias("state"))


def training_metrics(spark: SparkSession, root: str, epochs: int) -> DataFrame:
    """Loss per epoch over all shards, and per batch for shard 0."""
    if epochs == 0:
        return spark.createDataFrame([], "tag string, step bigint, value double")
    log = spark.read.parquet(root).withColumn("epoch", F.col("epoch").cast("bigint"))
    per_epoch = log.filter("batches > 0").groupBy("epoch").agg(
        (F.sum(F.col("loss") * F.col("batches")) / F.sum("batches")).alias("value")).select(
        F.lit(EPOCH_LOSS).alias("tag"), F.col("epoch").alias("step"), "value")
    per_batch = log.filter("shard = 0").select("epoch", "batches", F.posexplode("losses").alias("idx", "value")).select(
        F.lit(BATCH_LOSS).alias("tag"), (F.col("epoch") * F.col("batches") + F.col("idx")).alias("step"), "value")
    return per_epoch.unionByName(per_batch)


# Model type -> estimator.
MODELS = {"autoencoder": Autoencoder}


def get_model(params: TrainParams) -> Autoencoder:
    if params.model_type not in MODELS:
        raise ValueError(f"no model of type {params.model_type!r}, only {sorted(MODELS)}")
    return MODELS[params.model_type](params)


def _whole_row(rows: DataFrame, columns: Sequence[str] | None) -> list:
    return [F.col(f"`{c}`") for c in sorted(columns or rows.columns) if c != "shard"]


def row_order(rows: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row's place among its shard's: equal rows share one. `columns` are all unless named."""
    return F.xxhash64(F.lit("place"), *_whole_row(rows, columns))


def assign_shards(features: DataFrame, shards: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Numbers the shard of every row by the hash of all its columns, or of those named."""
    return features.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), *_whole_row(features, columns)), F.lit(shards)).cast("int"))

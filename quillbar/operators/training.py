"""Training by epochs: mini-batches over the cluster, AdamW, checkpoints, resuming.

Samples are dealt into batches once, written by batch and spread over ``spread`` files
each. A step reads one batch; every task sums the gradients of its rows, sums are added
up in two levels, and the driver holds nothing but the parameters. The loss is the
cross-entropy weighed by class; gradients are clipped by their global norm. Batches come
in another order each epoch, by the seed.

After an epoch the split ``val`` is scored. The best epoch by macro-F1 is kept (of equal
ones the first), every ``every``-th and the last are checkpoints. A run that starts in
a folder with checkpoints goes on from the last, and ends as an unbroken one does: the
batches are there, and sums are made in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import batches, class_weights
from .metrics import scores


@dataclass(frozen=True)
class Training:
    """``hidden``: units of a layer between input and scores; 0: none, a linear model."""

    classes: int = 2
    hidden: int = 0
    epochs: int = 400
    batch: int = 64
    rate: float = 5e-4
    decay: float = 0.01
    clip: float = 1.0
    seed: int = 0
    every: int = 10
    spread: int = 1


@dataclass
class State:
    """Parameters, AdamW's two means, and steps and epochs made; ``history`` has (epoch,
    loss, accuracy, macro_f1) rows."""

    params: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int
    epoch: int
    best: float
    history: list[tuple[int, float, float, float]]


CHECKPOINT = "params array<double>, first array<double>, second array<double>, step long, best double, history array<struct<epoch: int, loss: double, accuracy: double, macro_f1: double>>, epoch int"


def shapes(width: int, config: Training) -> list[tuple[int, ...]]:
    inner = [(width, config.hidden), (config.hidden,)] if config.hidden else []
    return [*inner, (config.hidden or width, config.classes), (config.classes,)]


def start(width: int, config: Training) -> State:
    rng = np.random.default_rng(config.seed)
    parts = [rng.normal(0, 1 / np.sqrt(s[0]), s).ravel() if len(s) > 1 else np.zeros(s) for s in shapes(width, config)]
    params = np.concatenate(parts)
    return State(params, np.zeros_like(params), np.zeros_like(params), 0, 0, -1.0, [])


def _layers(params: np.ndarray, width: int, config: Training) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(width, config):
        size = int(np.prod(s))
        out.append(params[at : at + size].reshape(s))
        at += size
    return out


def class_scores(params: np.ndarray, x: np.ndarray, config: Training) -> np.ndarray:
    *inner, w, b = _layers(params, x.shape[1], config)
    return (np.maximum(x @ inner[0] + inner[1], 0.0) if inner else x) @ w + b


def gradient(params: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray, config: Training) -> tuple[float, float, np.ndarray]:
    """Weighed sums over rows: loss, weight, gradient."""
    *inner, w, b = _layers(params, x.shape[1], config)
    h = np.maximum(x @ inner[0] + inner[1], 0.0) if inner else x
    z = h @ w + b
    z = z - z.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    of = weights[y]
    loss = -(of * log_p[np.arange(len(y)), y]).sum()
    d = np.exp(log_p)
    d[np.arange(len(y)), y] -= 1.0
    d *= of[:, None]
    parts = [h.T @ d, d.sum(axis=0)]
    if inner:
        back = (d @ w.T) * (h > 0)
        parts = [x.T @ back, back.sum(axis=0), *parts]
    return float(loss), float(of.sum()), np.concatenate([p.ravel() for p in parts])


def adamw(state: State, grad: np.ndarray, config: Training) -> None:
    """One step, in place."""
    norm = float(np.sqrt((grad**2).sum()))
    grad = grad * min(1.0, config.clip / (norm + 1e-6))
    state.step += 1
    state.first = 0.9 * state.first + 0.1 * grad
    state.second = 0.999 * state.second + 0.001 * grad**2
    mean, spread = state.first / (1 - 0.9**state.step), state.second / (1 - 0.999**state.step)
    state.params = state.params * (1 - config.rate * config.decay) - config.rate * mean / (np.sqrt(spread) + 1e-8)


def _cells(batch: pa.RecordBatch) -> np.ndarray:
    """features as rows of numbers."""
    column = batch.column(batch.schema.get_field_index("features"))
    return column.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


SUMS = "part int, loss double, weight double, n long, grad array<double>"


def _add(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row from many, added in their order."""
    total: list | None = None
    for batch in batches_:
        for r in batch.to_pylist():
            grad = np.array(r["grad"])
            total = [r["part"], r["loss"], r["weight"], r["n"], grad] if total is None else [total[0], total[1] + r["loss"], total[2] + r["weight"], total[3] + r["n"], total[4] + grad]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int32()), *[pa.array([x]) for x in total[1:4]], pa.array([total[4].tolist()], pa.list_(pa.float64()))], names=["part", "loss", "weight", "n", "grad"])


def step_sums(rows: DataFrame, params: np.ndarray, weights: np.ndarray, config: Training) -> tuple[float, float, int, np.ndarray]:
    """Loss, weight, rows and gradient of a batch. Tasks make a row each; 16 tasks add
    these up, so the driver gets 16 rows at most, however many tasks there were."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, weight, n, grad = 0.0, 0.0, 0, np.zeros_like(params)
        for batch in parts:
            if batch.num_rows:
                y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
                made = gradient(params, _cells(batch), y, weights, config)
                loss, weight, n, grad = loss + made[0], weight + made[1], n + batch.num_rows, grad + made[2]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([loss]), pa.array([weight]), pa.array([n], pa.int64()), pa.array([grad.tolist()], pa.list_(pa.float64()))], names=["part", "loss", "weight", "n", "grad"])

    sums = rows.select("features", "y").mapInArrow(run, SUMS).withColumn("part", F.spark_partition_id())
    if config.spread > 16:
        sums = sums.repartition(16, F.pmod("part", F.lit(16))).sortWithinPartitions("part").mapInArrow(_add, SUMS)
    total = None
    for r in sorted(sums.collect(), key=lambda r: r["part"]):
        now = (r["loss"], r["weight"], r["n"], np.array(r["grad"]))
        total = now if total is None else tuple(a + b for a, b in zip(total, now, strict=True))
    if total is None:
        raise ValueError("a batch without rows")
    return total


def predicted(samples: DataFrame, params: np.ndarray, config: Training) -> DataFrame:
    """y, pred."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if batch.num_rows:
                pred = class_scores(params, _cells(batch), config).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), pa.array(pred, pa.int64())], names=["y", "pred"])

    return samples.select("features", F.col("y").cast("long").alias("y")).mapInArrow(run, "y long, pred long")


def save(spark: SparkSession, path: str, state: State) -> None:
    row = (state.params.tolist(), state.first.tolist(), state.second.tolist(), state.step, state.best, state.history)
    schema = CHECKPOINT.removesuffix(", epoch int")
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={state.epoch}")


def load(spark: SparkSession, path: str) -> State | None:
    """The checkpoint of the latest epoch; None if there is none."""
    try:
        row = spark.read.schema(CHECKPOINT).parquet(path).orderBy(F.desc("epoch")).first()
    except AnalysisException:  # nothing there yet
        return None
    if row is None:
        return None
    history = [tuple(h) for h in row["history"]]
    return State(np.array(row["params"]), np.array(row["first"]), np.array(row["second"]), row["step"], row["epoch"], row["best"], history)


def fit(samples: DataFrame, folder: str, config: Training | None = None) -> State:
    """Trains on the split ``train`` of samples (split, end_dt, symbol, features, y) up to
    ``epochs``, in a folder that all executors share; its ``best`` and ``checkpoints`` are
    read by load()."""
    config = config or Training()
    spark = samples.sparkSession
    train, held = samples.where("split = 'train'"), samples.where("split = 'val'")
    state = load(spark, f"{folder}/checkpoints")
    if state is None:
        dealt = batches(train, config.batch, seed=config.seed)
        file = F.pmod(F.xxhash64("symbol", "end_dt"), F.lit(config.spread))
        dealt.repartition("batch", file).sortWithinPartitions("batch", "symbol", "end_dt").write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/batches")
        first = train.select(F.size(F.flatten("features")).alias("n")).first()
        if first is None:
            raise ValueError("no samples to train on")
        state = start(first["n"], config)
        save(spark, f"{folder}/checkpoints", state)
    dealt = spark.read.parquet(f"{folder}/batches")
    count = dealt.agg(F.max("batch")).first()[0] + 1  # of the folders' names
    weights = np.array([r["weight"] for r in sorted(class_weights(dealt, config.classes, "y").collect(), key=lambda r: r["y"])])
    while state.epoch < config.epochs:
        state.epoch += 1
        losses = rows = 0.0
        for k in np.random.default_rng([config.seed, state.epoch]).permutation(count):
            loss, weight, n, grad = step_sums(dealt.where(F.col("batch") == int(k)), state.params, weights, config)
            adamw(state, grad / weight, config)
            losses, rows = losses + loss / weight * n, rows + n
        found = scores(predicted(held, state.params, config), config.classes).first()
        f1 = found["macro_f1"] or 0.0
        state.history.append((state.epoch, losses / rows, found["accuracy"], f1))
        if f1 > state.best:
            state.best = f1
            save(spark, f"{folder}/best", state)
        if state.epoch % config.every == 0 or state.epoch == config.epochs:
            save(spark, f"{folder}/checkpoints", state)
    return state

"""Training a network of ReLU layers with softmax loss by mini-batches, each step's gradient a sum over partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import ship_package, work_path

Layers = list[tuple[np.ndarray, np.ndarray]]


def initial_layers(sizes: Sequence[int], seed: int = 0) -> Layers:
    """Normal weights of standard deviation 0.1 and biases of 0.1."""
    random = np.random.default_rng(seed)
    return [(random.normal(0, 0.1, (a, b)), np.full(b, 0.1)) for a, b in zip(sizes, sizes[1:])]


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """The values of every layer; all but the last pass a ReLU."""
    values = [x]
    for i, (weights, biases) in enumerate(layers):
        z = values[-1] @ weights + biases
        values.append(np.maximum(z, 0) if i + 1 < len(layers) else z)
    return values


def gradient_sums(layers: Layers, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Sums over some rows, flat: the loss, the rows, then each layer's weight and bias gradients."""
    values = forward(layers, x)
    z = values[-1] - values[-1].max(axis=1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    rows = np.arange(len(x))
    delta = np.exp(logs)
    delta[rows, label] -= 1
    parts = []
    for i in reversed(range(len(layers))):
        parts.append(np.concatenate([(values[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ layers[i][0].T) * (values[i] > 0)
    return np.concatenate([[-logs[rows, label].sum(), len(x)], *reversed(parts)])


def descend(layers: Layers, sums: np.ndarray, rate: float) -> Layers:
    """The layers after one step along the mean gradient."""
    at, out = 2, []
    for weights, biases in layers:
        step = sums[at : at + weights.size + biases.size] / sums[1]
        out.append((weights - rate * step[: weights.size].reshape(weights.shape), biases - rate * step[weights.size :]))
        at += weights.size + biases.size
    return out


def _sums(batch: DataFrame, layers: Layers) -> np.ndarray:
    """The gradient sums of a mini-batch: each task adds up its rows, Spark the tasks by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in batches:
            if not rows.num_rows:
                continue
            x = rows.column(0).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            sums = gradient_sums(layers, x, rows.column(1).to_numpy())
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "v"])

    summed = batch.select("features", "label").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    found = summed.toArrow()  # as many rows as the network has weights
    out = np.zeros(2 + sum(w.size + b.size for w, b in layers))
    out[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return out


def train_minibatches(samples: DataFrame, layers: Layers, steps: int, rate: float) -> tuple[Layers, list[float]]:
    """Stochastic gradient descent: the layers after ``steps`` steps, and the mean loss of each step's mini-batch.

    ``samples`` has ``features`` (array<double>), ``label`` (int) and ``batch``, the mini-batch of a row, from 0 without
    gaps (``fixed_batches`` numbers shuffled rows so); step t takes batch t, from the start again after the last. Rows without
    features or label are left out; a batch without any row changes nothing and has no loss. The rows are written once, sorted
    by batch over all partitions of a range, so a step reads the files of its own batch only, however large the table; the driver holds the weights.
    """
    spark = samples.sparkSession
    ship_package(spark)
    path = work_path(spark, "minibatches")
    good = samples.where("features IS NOT NULL AND label IS NOT NULL")
    kept = good.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"), F.col("batch").cast("bigint").alias("batch"))
    kept.repartitionByRange("batch").sortWithinPartitions("batch").write.parquet(path)
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    losses: list[float] = []
    for step in range(steps if last is not None else 0):
        sums = _sums(rows.where(F.col("batch") == step % (last + 1)), layers)
        losses.append(float(sums[0] / sums[1]) if sums[1] else float("nan"))
        layers = descend(layers, sums, rate) if sums[1] else layers
    return layers, losses


def predict(rows: DataFrame, layers: Layers) -> DataFrame:
    """The rows with ``pred``, the class of the largest output, the first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("features")
            features = batch.column(at)
            found = np.full(batch.num_rows, -1, np.int32)
            valid = ~features.is_null().to_numpy(zero_copy_only=False)
            if valid.any():
                x = features.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows - features.null_count, -1)
                found[valid] = forward(layers, x.astype(float))[-1].argmax(axis=1)
            pred = pa.array(found, mask=~valid)
            yield pa.RecordBatch.from_arrays([*batch.columns, pred], [*batch.schema.names, "pred"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, pred int")

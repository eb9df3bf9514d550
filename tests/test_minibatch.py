"""Mini-batch training against a NumPy model, and what a trained network gets right."""

from __future__ import annotations

import random

import numpy as np
import pytest

from framewright.operators import minibatch as mb

SCHEMA = "features array<double>, label int, batch bigint, a string"


def table(n, seed=1, width=4, classes=3):
    """Points around a centre of their class, in mini-batches of 16."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 2, (classes, width))
    labels = rng.integers(0, classes, n)
    x = centres[labels] + rng.normal(0, 0.4, (n, width))
    return [(x[i].tolist(), int(labels[i]), i // 16, "z") for i in range(n)]


def numpy_training(rows, layers, steps, rate):
    """One network, one process, gradients by central differences of the loss at random places."""
    batches = 1 + max(r[2] for r in rows)
    losses = []
    for step in range(steps):
        mine = [r for r in rows if r[2] == step % batches]
        x, y = np.array([r[0] for r in mine]), np.array([r[1] for r in mine])
        values = [x]
        for i, (w, b) in enumerate(layers):
            z = values[-1] @ w + b
            values.append(np.maximum(z, 0) if i + 1 < len(layers) else z)
        p = np.exp(values[-1] - values[-1].max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        d = (p - np.eye(p.shape[1])[y]) / len(y)
        out = []
        for i in reversed(range(len(layers))):
            w, b = layers[i]
            out.append((w - rate * values[i].T @ d, b - rate * d.sum(0)))
            d = (d @ w.T) * (values[i] > 0)
        layers = out[::-1]
    return layers, losses


@pytest.mark.parametrize("sizes", [[4, 3], [4, 8, 3], [4, 8, 5, 3]])
def test_weights_equal_a_single_process(spark, sizes):
    rows = table(100)
    start = mb.initial_layers(sizes, 3)
    found, losses = mb.train_minibatches(spark.createDataFrame(rows, SCHEMA).repartition(5), start, 9, 0.2)
    expected, other = numpy_training(rows, start, 9, 0.2)
    assert np.allclose(losses, other, rtol=0, atol=1e-12)
    for (w, b), (v, c) in zip(found, expected, strict=True):
        assert np.allclose(w, v, rtol=0, atol=1e-9) and np.allclose(b, c, rtol=0, atol=1e-9)


def test_gradients_are_slopes_of_the_loss():
    rng, rows = random.Random(2), table(20)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    layers = mb.initial_layers([4, 6, 3], 5)
    sums = mb.gradient_sums(layers, x, y)
    for _ in range(30):
        at = rng.randrange(len(sums) - 2)

        def moved(e, at=at):
            flat = np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers])
            flat[at] += e
            out, i = [], 0
            for w, b in layers:
                out.append((flat[i : i + w.size].reshape(w.shape), flat[i + w.size : i + w.size + b.size]))
                i += w.size + b.size
            return mb.gradient_sums(out, x, y)[0]

        assert abs((moved(1e-6) - moved(-1e-6)) / 2e-6 - sums[2 + at]) < 1e-4


def test_a_trained_network_knows_held_back_rows(spark):
    rows = spark.createDataFrame(table(600), SCHEMA)
    layers, losses = mb.train_minibatches(rows.where("batch < 20"), mb.initial_layers([4, 16, 3]), 60, 0.2)
    held = mb.predict(rows.where("batch >= 20"), layers)
    assert losses[-1] < losses[0] / 4
    assert held.where("pred = label").count() > 0.95 * held.count() > 200


def test_edges(spark):
    start = mb.initial_layers([2, 2])
    assert mb.train_minibatches(spark.createDataFrame([], SCHEMA), start, 3, 0.1) == (start, [])
    rows = [(None, 1, 0, "x"), ([1.0, 2.0], None, 0, "x"), ([1.0, 2.0], 1, 0, None), ([1.0, 2.0], 1, 2, None)]
    layers, losses = mb.train_minibatches(spark.createDataFrame(rows, SCHEMA), start, 3, 0.1)
    assert np.isnan(losses[1]) and losses[2] < losses[0]
    assert [r.pred is None for r in mb.predict(spark.createDataFrame(rows, SCHEMA), layers).collect()] == [True, False, False, False]

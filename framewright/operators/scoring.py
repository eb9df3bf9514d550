"""Model scoring over tables: layer stacks, classifiers, detectors.

A model is a function that builds a predictor; Spark calls it once per Python worker and then
feeds it Arrow batches, so nothing about the model travels per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.arrays import argmax, softmax
from framewright.operators.detection import annotations


@dataclass(frozen=True)
class Dense:
    weights: np.ndarray  # (inputs, outputs)
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


@dataclass(frozen=True)
class LeakyRelu:
    alpha: float = 0.2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x, self.alpha * x)


@dataclass(frozen=True)
class Conv2d:
    """Valid convolution, stride 1, of (batch, rows, columns, channels)."""

    kernel: np.ndarray  # (rows, columns, channels in, channels out)
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(x, self.kernel.shape[:2], axis=(1, 2))
        return np.einsum("bhwcij,ijco->bhwo", windows, self.kernel, optimize=True) + self.bias


@dataclass(frozen=True)
class MaxPool:
    size: int = 2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        batch, rows, columns, channels = x.shape
        rows, columns = rows // self.size, columns // self.size
        cut = x[:, : rows * self.size, : columns * self.size]
        return cut.reshape(batch, rows, self.size, columns, self.size, channels).max(axis=(2, 4))


@dataclass(frozen=True)
class Flatten:
    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), -1)


Layer = Callable[[np.ndarray], np.ndarray]


def run_layers(layers: Sequence[Layer], x: np.ndarray) -> np.ndarray:
    for layer in layers:
        x = layer(x)
    return x


def layer_stack(make_layers: Callable[[], Sequence[Layer]], shape: Sequence[int], batch_size: int = 1024):
    """A column function scoring flat number arrays of the given shape with a layer stack."""

    def make_predict():
        layers = make_layers()
        return lambda batch: run_layers(layers, batch.astype(np.float64))

    return predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(shape)],
    )


def batch_inference(rows: DataFrame, model: Callable[[Column], Column], features: str = "features") -> DataFrame:
    """Logits, predicted class and its probability for every row."""
    return (
        rows.withColumn("logits", model(F.col(features)))
        .withColumn("pred", argmax(F.col("logits")))
        .withColumn("probability", F.array_max(softmax(F.col("logits"))))
    )


DETECTION_TYPE = T.StructType(
    [
        T.StructField("boxes", T.ArrayType(T.DoubleType())),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("classes", T.ArrayType(T.DoubleType())),
    ]
)


def detector(
    make_detect: Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]],
    shape: Sequence[int],
    batch_size: int = 64,
):
    """A column function from images to boxes (batch, N, 4), scores and classes (batch, N)."""

    def make_predict():
        detect = make_detect()

        def predict(batch: np.ndarray) -> dict[str, np.ndarray]:
            boxes, scores, classes = detect(batch)
            return {"boxes": boxes.reshape(len(batch), -1), "scores": scores, "classes": classes}

        return predict

    return predict_batch_udf(
        make_predict, return_type=DETECTION_TYPE, batch_size=batch_size, input_tensor_shapes=[list(shape)]
    )


def detect_objects(
    images: DataFrame,
    model: Callable[[Column], Column],
    labels: DataFrame,
    width: int,
    height: int,
    pixels: str = "pixels",
) -> DataFrame:
    """Images to annotations; pixels are dropped before the label join."""
    found = images.withColumn("_d", model(F.col(pixels))).drop(pixels)
    n = F.size("_d.scores")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    boxes = F.transform(numbers, lambda i: F.slice(F.col("_d.boxes"), i * 4 + 1, F.lit(4)))
    raw = found.select(
        *[c for c in found.columns if c != "_d"], boxes.alias("boxes"), "_d.scores", "_d.classes"
    )
    return annotations(raw, labels, width, height)

"""Classifier training and evaluation with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_vectors(rows: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    others = [c for c in rows.columns if c not in (features, label)]
    return rows.select(*others, array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"))


def mlp_train(
    train: DataFrame, layers: Sequence[int], max_iter: int = 50, seed: int = 42, block_size: int = 128
) -> MultilayerPerceptronClassificationModel:
    """Fit a multilayer perceptron on array features and an int label."""
    trainer = MultilayerPerceptronClassifier(
        layers=list(layers), maxIter=max_iter, seed=seed, blockSize=block_size, featuresCol="features", labelCol="label"
    )
    return trainer.fit(as_vectors(train))


def mlp_predict(model: MultilayerPerceptronClassificationModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(as_vectors(rows))
    return scored.withColumn("pred", F.col("prediction").cast("int")).withColumn("label", F.col("label").cast("int"))


def mlp_train_predict(split: DataFrame, layers: Sequence[int], max_iter: int = 50, seed: int = 42) -> DataFrame:
    """Train on the ``train`` rows of a split and report accuracy for each part of it."""
    model = mlp_train(split.where(F.col("dataset") == "train"), layers, max_iter, seed)
    hit = (F.col("pred") == F.col("label")).cast("double")
    return (
        mlp_predict(model, split)
        .groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
    )

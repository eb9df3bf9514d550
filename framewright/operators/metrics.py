"""Classifier evaluation over (label, pred) and (logits, label) columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.arrays import cross_entropy


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def precision_recall_f1(predictions: DataFrame) -> DataFrame:
    """Per-class precision, recall and F1 from the confusion matrix; undefined ratios are null."""
    cells = confusion_matrix(predictions)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted")),
                F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted")),
            )
        ).alias("s"),
        F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
    )
    totals = sides.groupBy(F.col("s.class").alias("class")).agg(
        F.sum("s.actual").alias("actual"),
        F.sum("s.predicted").alias("predicted"),
        # a hit cell appears once per side
        (F.sum("hit") / 2).cast("bigint").alias("tp"),
    )
    return totals.select(
        "class",
        "tp",
        "actual",
        "predicted",
        F.try_divide("tp", "predicted").alias("precision"),
        F.try_divide("tp", "actual").alias("recall"),
        F.try_divide(2 * F.col("tp"), F.col("actual") + F.col("predicted")).alias("f1"),
    )


def dataset_loss(scored: DataFrame) -> DataFrame:
    """Mean sparse-softmax cross-entropy."""
    return scored.agg(F.avg(cross_entropy(F.col("logits"), F.col("label"))).alias("loss"))

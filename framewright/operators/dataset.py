"""Dataset preparation: balance, split, shuffle, batch, index."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.arrays import places
from framewright.operators.ordering import (
    seeded_order,
    with_global_index,
    with_group_index,
)

SPLITS = ("train", "validation", "test")
MAX_CLASSES = 10_000


def class_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_counts_min(samples: DataFrame) -> DataFrame:
    """Samples per class, with the smallest class beside each."""
    counts = class_counts(samples)
    return counts.withColumn("n_min", counts.agg(F.min("n")).scalar())


def _smallest_class(samples: DataFrame) -> int:
    return class_counts(samples).agg(F.min("n")).first()[0] or 0


def _place() -> Column:
    """Where the hash ``_key`` stands among all hashes, from 0 up to 1."""
    return F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def _likely_first(keyed: DataFrame, k: int) -> DataFrame:
    """Leave out rows that cannot be among the first ``k`` of their class by ``_key``.

    Keys are uniform hashes, so the first k of n lie below about k/n of the key range; a margin of
    eight deviations is kept and then checked by counting, so no class ever comes out short. Used
    only where it at least halves the rows and there are few enough classes to broadcast.
    """
    sizes = class_counts(keyed).limit(MAX_CLASSES + 1).collect()
    if len(sizes) > MAX_CLASSES or sum(r["n"] for r in sizes) < 2 * k * len(sizes):
        return keyed
    bounds = [(r["label"], min(1.0, (k + 8 * math.sqrt(k) + 16) / r["n"])) for r in sizes]
    label = keyed.schema["label"]
    table = keyed.sparkSession.createDataFrame(
        bounds, T.StructType([T.StructField("_label", label.dataType), T.StructField("_bound", T.DoubleType())])
    )
    kept = (
        keyed.join(F.broadcast(table), F.col("label").eqNullSafe(F.col("_label")))
        .where(_place() < F.col("_bound"))
        .select(*keyed.columns)
    )
    fewest = class_counts(kept).agg(F.min("n"), F.count(F.lit(1))).first()
    return kept if fewest[1] == len(sizes) and fewest[0] >= k else keyed


def _balanced(samples: DataFrame, k: int, seed: int, hot_rows: int | None) -> DataFrame:
    keyed = _likely_first(samples.withColumn("_key", seeded_order(seed, "id")), k)
    indexed = with_group_index(keyed, ["label"], ["_key", "id"], "idx", hot_rows)
    return indexed.drop("_key").where(F.col("idx") < k)


def balanced_sample(samples: DataFrame, seed: int = 0, hot_rows: int | None = None) -> DataFrame:
    """From each class, in seeded order, as many samples as the smallest class has."""
    return _balanced(samples, _smallest_class(samples), seed, hot_rows)


def percent_split(
    samples: DataFrame, percents: Sequence[float], seed: int = 0, hot_rows: int | None = None
) -> DataFrame:
    """Balanced sample cut per class into consecutive percentage ranges; the remainder is dropped."""
    k = _smallest_class(samples)
    dataset, start = F.lit(None).cast("string"), 0
    for name, percent in zip(SPLITS, percents):
        end = start + int(percent / 100.0 * k)
        dataset = F.coalesce(dataset, F.when((F.col("idx") >= start) & (F.col("idx") < end), name))
        start = end
    balanced = _balanced(samples, k, seed, hot_rows)
    return balanced.withColumn("dataset", dataset).where(F.col("dataset").isNotNull())


def seeded_shuffle(samples: DataFrame, seed: int = 0) -> DataFrame:
    """Every sample with its place ``idx`` in a reproducible shuffle.

    The keys are uniform hashes, so ranges of equal width hold about equally many rows: a row's range follows
    from its key alone, no bounds are drawn and nothing is written. The ranges' counts give each its first place.
    """
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(seeded_order(seed, "id"), F.lit("0"))
    keyed = samples.withColumn("_key", key).withColumn("_range", F.floor(_place() * n).cast("int"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    firsts = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key", "id")) - 1
    placed = keyed.withColumn("_i", inside).join(firsts, "_range")
    return placed.withColumn("idx", (F.col("_first") + F.col("_i")).cast("bigint")).drop("_key", "_range", "_i", "_first")


def take_drop_split(samples: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """First k shuffled rows train, the rest test."""
    return seeded_shuffle(samples, seed).withColumn("dataset", F.when(F.col("idx") < k, "train").otherwise("test"))


def ratio_split(samples: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """A ratio of the shuffled rows trains, the rest tests."""
    size = samples.agg(F.floor(F.count(F.lit(1)) * ratio)).scalar()
    return seeded_shuffle(samples, seed).withColumn(
        "dataset", F.when(F.col("idx") < size, "train").otherwise("test")
    )


def balanced_ratio_split(
    samples: DataFrame, ratio: float, seed: int = 0, hot_rows: int | None = None
) -> DataFrame:
    """The same ratio inside every class of a balanced sample."""
    k = _smallest_class(samples)
    return _balanced(samples, k, seed, hot_rows).withColumn(
        "dataset", F.when(F.col("idx") < int(k * ratio), "train").otherwise("test")
    )


def fixed_batches(samples: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Consecutive batches of the shuffled rows; the last may be short."""
    indexed = seeded_shuffle(samples, seed).withColumn("batch", F.floor(F.col("idx") / size).cast("bigint"))
    return indexed.groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct("idx", "id", "label"))).alias("rows"),
        F.count(F.lit(1)).alias("n"),
    )


def label_index(samples: DataFrame) -> DataFrame:
    """Class names to 0-based places in name order, joined back to the samples; no label has no place."""
    names = sort_by_name(samples.select("label").where("label is not null").distinct(), "label")
    return samples.join(names.withColumnRenamed("place", "label_idx"), "label", "left")


def sort_by_name(classes: DataFrame, name: str) -> DataFrame:
    """Distinct names in ascending order with their 0-based ``place``."""
    return with_global_index(classes, [name], "place")


def training_schedule(samples: DataFrame, batch_size: int, epochs: int, seed: int = 0) -> DataFrame:
    """Full batches numbered as training steps: floor(N / batch) steps per epoch.

    One row a step of every epoch, with the ids of its samples in shuffled order.
    """
    per_epoch = samples.agg(F.floor(F.count(F.lit(1)) / batch_size)).scalar()
    indexed = seeded_shuffle(samples, seed).withColumn("batch", F.floor(F.col("idx") / batch_size).cast("bigint"))
    full = indexed.withColumn("_per_epoch", per_epoch).where(F.col("batch") < F.col("_per_epoch"))
    return (
        full.groupBy("batch", "_per_epoch")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("idx").alias("first_idx"),
            F.transform(F.sort_array(F.collect_list(F.struct("idx", "id"))), lambda s: s["id"]).alias("ids"),
        )
        .withColumn("epoch", F.explode(places(epochs)))
        .withColumn("step", F.col("epoch") * F.col("_per_epoch") + F.col("batch"))
        .drop("_per_epoch")
    )


def zip_features_labels(features: DataFrame, labels: DataFrame, feature_order: str, label_order: str) -> DataFrame:
    """Positional zip of two tables, cut to the shorter."""
    left = with_global_index(features, [feature_order], "pos")
    right = with_global_index(labels, [label_order], "pos")
    return left.join(right, "pos")

"""CSV features, label maps and split datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_feature_scan(spark: SparkSession, path: str, n_features: int = 4) -> DataFrame:
    """CSV with a header line: the first columns are the feature vector, the next one the label."""
    names = [f"c{i}" for i in range(n_features)]
    schema = ", ".join([*[f"{n} double" for n in names], "label double"])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return rows.select(F.array(*names).alias("features"), F.col("label").cast("int").alias("label"))


def write_csv_features(rows: DataFrame, path: str, features: Sequence[str], label: str) -> None:
    rows.select(*features, label).write.mode("overwrite").option("header", True).csv(path)


# A quoted name: what stands between quotes of one kind, where a backslash takes the next character along.
_QUOTED = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
_ITEM = rf"""(?s)item\s*\{{((?:[^{{}}"']|{_QUOTED})*)\}}"""


def _escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _unescaped(quoted: Column) -> Column:
    """The text of a quoted name without its quotes and backslashes."""
    return F.regexp_replace(F.expr("substring(_q, 2, char_length(_q) - 2)"), r"(?s)\\(.)", "$1")


def write_label_map(labels: DataFrame, path: str) -> None:
    """Labels (``pos``, ``id``, ``display_name``; null fields are left out) as pbtxt items in order."""
    fields = F.concat(
        F.coalesce(F.format_string("  id: %d\n", "id"), F.lit("")),
        F.coalesce(F.concat(F.lit('  display_name: "'), _escaped(F.col("display_name")), F.lit('"\n')), F.lit("")),
    )
    item = F.concat(F.lit("item {\n"), fields, F.lit("}"))
    labels.repartitionByRange("pos").sortWithinPartitions("pos").select(item).write.mode("overwrite").text(path)


def label_map_scan(spark: SparkSession, path: str) -> DataFrame:
    """pbtxt items to (id, display_name); incomplete items are dropped, the last of an id wins.

    A label map describes the classes of one model, so each file is read whole; names may hold braces
    and either quote. Item order is (file, position).
    """
    files = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value")
    found = files.select("file_path", F.posexplode(F.regexp_extract_all("value", F.lit(_ITEM), F.lit(1))).alias("at", "item"))
    bare = F.regexp_replace("item", F.lit(_QUOTED), F.lit('""'))
    items = (
        found.withColumn("_q", F.regexp_extract("item", rf"(?s)\bdisplay_name\s*:\s*({_QUOTED})", 1))
        .select(
            F.struct("file_path", "at").alias("pos"),
            F.regexp_extract(bare, r"\bid\s*:\s*(\d+)", 1).try_cast("int").alias("id"),
            _unescaped(F.col("_q")).alias("display_name"),
        )
    )
    complete = items.where(F.col("id").isNotNull() & (F.col("display_name") != ""))
    return complete.groupBy("id").agg(F.max_by("display_name", "pos").alias("display_name"))


def split_dataset_write(samples: DataFrame, path: str) -> None:
    """Samples laid out as ``dataset=<split>/label=<class>/``."""
    samples.write.mode("overwrite").partitionBy("dataset", "label").parquet(path)

"""Shared parts of the operators that link rows: stored tables, filters, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import ship_package, work_path

#: What of a table crosses to a Python worker at once, at most: long texts make the default of 10,000 rows large on
#: both sides. It bounds memory and changes no result.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Give the workers this package and bound the batches that they get."""
    ship_package(spark)
    rows, size = (f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size) == "67108864b":  # as Spark has it by default
        spark.conf.set(size, str(BATCH_BYTES))


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows written to the shared folder, with Spark's ``options``, and read again: computed once, and no lost executor takes them along."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each vertex with the least of its part."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > 1 << 20:
            yield _stars(root, find)
            root.clear()
    yield _stars(root, find)


def _stars(root: dict[int, int], find) -> pa.RecordBatch:
    vertices = list(root)
    columns = [pa.array(vertices, pa.int64()), pa.array([find(v) for v in vertices], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``edges`` (a, b: bigint), the component being its least vertex.

    Each partition first replaces its edges by stars. Then large-star and small-star steps alternate: every vertex
    hangs its larger neighbours on the least it knows, then its smaller ones. A step is two aggregations and two
    joins, whatever the graph, the steps grow with the logarithm of the longest path, and
    each is written to the shared folder. Loops and repeated edges do no harm.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs.mapInArrow(_forest, "a bigint, b bigint").where("a != b"), "edges")
    seen = None
    while True:
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return pairs.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
                pairs.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
            )
        seen = mark
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = hung.union(least.select("a", F.col("m").alias("b"))).where("a != b")
        pairs = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A packed array of ``bits`` bits in which both probes of every value of the column ``hash`` are set.

    The partitions' arrays are merged by an aggregation; the driver receives the merged bytes, a fixed number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for probe in probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                own[probe] = True
        packed = np.packbits(own, bitorder="little")
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(packed[at].astype(np.int64))], ["at", "bits"])

    cells = hashes.select("hash").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    found, merged = cells.toArrow(), np.zeros(bits // 8, np.uint8)
    merged[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return merged


def probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)


def in_filter(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits set."""
    found = np.ones(len(hashes), bool)
    for probe in probes(hashes, len(packed) * 8):
        at = probe.astype(np.int64)
        found &= (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found

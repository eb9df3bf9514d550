"""The source of grabbed frames, and the table function handler."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pytest

from framewright.operators.handlers import handler_produce_table
from framewright.session import work_path
from framewright.sources.grabs import frame_grabs, grab_counts
from framewright.streaming.runner import run, write_batch

SCHEMA = "device int, ts bigint"


def land(spark, path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")
    return Path(path.removeprefix("file:")) / name


def take(spark, path, out):
    """Everything that has landed since the last call; the counts of what was skipped."""
    counts = {}
    grabs = frame_grabs(spark, path, SCHEMA, ("ts",))
    writer = grabs.writeStream.foreachBatch(lambda b, i: write_batch(b, f"{out}/rows", i))
    run(writer, f"{out}/checkpoint", lambda q: counts.update(grab_counts(q)))
    return counts


def taken(spark, out):
    return sorted((str(r.device), r.ts) for r in spark.read.parquet(f"{out}/rows").collect())


def test_failed_and_empty_grabs_are_skipped_and_counted(spark):
    path, out = work_path(spark, "grabs"), work_path(spark, "taken")
    first = land(spark, path, "001", [(1, 1), (2, None), (None, 2)])
    (first / "broken.parquet").write_bytes(b"no parquet")
    whole = next(first.glob("part-*.parquet")).read_bytes()
    (first / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (first / "empty.parquet").write_bytes(b"")
    spark.createDataFrame([("x",)], "ts string").coalesce(1).write.parquet(f"{path}/_other")
    other = next((Path(path.removeprefix("file:")) / "_other").glob("*.parquet"))
    (first / "other.parquet").write_bytes(other.read_bytes())
    assert take(spark, path, out) == {"grabbed": 2, "empty": 1, "failed": 4}
    assert taken(spark, out) == [("1", 1), ("None", 2)]

    # a later run goes on behind what the first one took; a slice that is not whole yet waits
    second = land(spark, path, "002", [(3, 3)])
    (second / "_SUCCESS").rename(second / "_waiting")
    assert take(spark, path, out) == {"grabbed": 0, "empty": 0, "failed": 0}
    (second / "_waiting").rename(second / "_SUCCESS")
    assert take(spark, path, out) == {"grabbed": 1, "empty": 0, "failed": 0}
    assert take(spark, path, out) == {"grabbed": 0, "empty": 0, "failed": 0}
    assert spark.read.parquet(f"{out}/rows").count() == 3


def test_no_grabs(spark):
    path, out = work_path(spark, "grabs"), work_path(spark, "taken")
    assert take(spark, path, out) == {"grabbed": 0, "empty": 0, "failed": 0}
    with pytest.raises(Exception, match="needs the schema"):
        spark.readStream.format("frame_grabs").option("path", path).load()


def test_rows_of_a_key_in_order_over_batches(spark):
    def twice():
        """Each row twice, with a number that rises over the key's batches."""
        n = 0

        def produce(batch):
            nonlocal n
            for value in batch.column("v").to_pylist():
                yield pa.table({"k": batch.column("k").take(pa.array([0, 0])), "v": pa.array([value] * 2), "n": pa.array([n, n + 1])})
                n += 2

        return produce

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(k, (i * 7) % 20) for k in ("a", "b", None) for i in range(20)], "k string, v bigint").repartition(4)
        out = handler_produce_table(rows, ["k"], ["v"], twice, "k string, v bigint, n bigint")
        assert "ArrowEvalPythonUDTF" in out._jdf.queryExecution().executedPlan().toString()
        found = sorted((str(r.k), r.n, r.v) for r in out.collect())
        assert found == sorted((k, n, n // 2) for k in ("a", "b", "None") for n in range(40))
        assert handler_produce_table(rows.limit(0), ["k"], ["v"], twice, "k string, v bigint, n bigint").collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

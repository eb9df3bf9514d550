"""Running streams into tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from framewright.session import work_path


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its id; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run(writer: DataStreamWriter, checkpoint: str, after: Callable[[StreamingQuery], None] | None = None) -> int:
    """Run a stream over everything now available; how many of its rows the watermark had passed and dropped.

    ``after`` gets the query once it is done.
    """
    query = started(writer.option("checkpointLocation", checkpoint).trigger(availableNow=True))
    query.awaitTermination()
    if after is not None:
        after(query)
    return late_rows(query)


def started(writer: DataStreamWriter) -> StreamingQuery:
    """Start a stream that remembers the progress of all its micro-batches."""
    SparkSession.active().conf.set("spark.sql.streaming.numRecentProgressUpdates", str(1 << 20))
    return writer.start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a query dropped because the watermark had passed them."""
    operators = [o for p in query.recentProgress for o in p["stateOperators"]]
    return sum(o["numRowsDroppedByWatermark"] for o in operators)


def replay(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Feed everything now available through ``sink`` and return when it is done: how many rows were late."""
    return run(stream.writeStream.foreachBatch(sink).outputMode(mode), checkpoint)


def replay_stopping(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, after: int, mode: str = "append") -> int:
    """As ``replay``, but stop the query between two micro-batches once ``after`` of them are done; how many were.

    What it has not seen is left for another run over the same checkpoint.
    """
    taken: list[int] = []

    def noted(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        taken.append(batch_id)

    writer = stream.writeStream.foreachBatch(noted).outputMode(mode).option("checkpointLocation", checkpoint)
    done = 0
    while done < after:
        taken.clear()
        query = started(writer.trigger(processingTime="1 day"))  # a micro-batch at once, the next one a day later
        while query.isActive and not (taken and any(p["batchId"] == taken[0] for p in query.recentProgress)):
            if not taken and query.status["message"].startswith("Waiting"):
                break  # there is nothing to take
            time.sleep(0.02)
        query.stop()
        if query.exception():
            raise query.exception()
        if not taken:
            break
        done += 1
    return done


def replay_to_table(stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Replay a stream into a parquet table with a ``batch_id`` column and read it back.

    Rows that came too late are counted, see ``dropped_rows``.
    """
    spark = stream.sparkSession
    path = path or work_path(spark, "stream")
    late = replay(stream, lambda batch, batch_id: write_batch(batch, f"{path}/out", batch_id), f"{path}/checkpoint", mode)
    if late:
        spark.range(1).select(F.lit(late).cast("bigint").alias("n")).write.mode("append").parquet(f"{path}/late")
    return spark.read.parquet(f"{path}/out")


def dropped_rows(spark: SparkSession, path: str) -> int:
    """How many rows the replays into a table have dropped as late."""
    try:
        return spark.read.parquet(f"{path}/late").agg(F.sum("n")).first()[0]
    except AnalysisException:
        return 0


def latest_per_key(updates: DataFrame, *keys: str) -> DataFrame:
    """Current value of each key of an update-mode table."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
        .select(*keys, *[F.col(f"_v.{c}") for c in values])
    )

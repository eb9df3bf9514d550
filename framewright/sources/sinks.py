"""Stream sinks: fan-out to several consumers and outgoing notifications."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.operators.frames import grouped_within
from framewright.operators.messages import TAG_FRAMES, encode_messages, frame_bytes
from framewright.sources import notifications
from framewright.sources.frames import frame_stream_scan
from framewright.streaming.frames import grouped_batches
from framewright.streaming.runner import replay, run, write_batch

Sink = Callable[[DataFrame, int], None]


def fan_out(sinks: Sequence[Sink]) -> Sink:
    """One sink feeding several: the micro-batch is read once, and the slowest sets the pace."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return each


def fan_out_sinks(stream: DataFrame, path: str, n: int) -> list[DataFrame]:
    """Replay a stream to ``n`` parquet sinks and read them back."""

    def table(i: int) -> Sink:
        return lambda batch, batch_id: write_batch(batch, f"{path}/sink{i}", batch_id)

    replay(stream, fan_out([table(i) for i in range(n)]), f"{path}/checkpoint")
    return [stream.sparkSession.read.parquet(f"{path}/sink{i}") for i in range(n)]


def encode_batches(batches: DataFrame, client_uuid: Column) -> DataFrame:
    """Frame batches as framed bytes of frame-sequence messages, one row per message."""
    messages = batches.select(
        F.col("device").alias("conn"),
        "window_start",
        "batch",
        F.lit(TAG_FRAMES).alias("tag"),
        F.lit(None).cast("int").alias("cmd"),
        F.lit(None).cast("string").alias("payload"),
        client_uuid.alias("client_uuid"),
        F.to_json("frames").alias("body"),
    )
    return frame_bytes(encode_messages(messages)).select("conn", "window_start", "batch", "data")


def notification_messages(
    frames: DataFrame, client_uuid: Column, size: int = 5, window: str = "1 second", counted: DataFrame | None = None
) -> DataFrame:
    """Frames of a table, batched, as messages. ``counted`` is the table to look for hot clients in where ``frames`` is
    costly to compute."""
    return encode_batches(grouped_within(frames, size, window, counted=counted), client_uuid)


def notification_sink(
    frames: DataFrame, path: str, client_uuid: Column, size: int = 5, window: str = "1 second", delay: str = "0 seconds"
) -> DataFrame:
    """Send a stream of frames as notifications, and return what was sent.

    Frames gather in batches over micro-batches, see ``grouped_batches``; each batch is one message. A micro-batch is sent
    whole or not at all, see ``notifications``.
    """
    spark = frames.sparkSession
    notifications.register(spark)
    messages = encode_batches(grouped_batches(frames, size, window, delay=delay), client_uuid)
    run(messages.writeStream.format("notification_log").option("path", f"{path}/log").outputMode("append"), f"{path}/checkpoint")
    return notifications.sent_notifications(spark, f"{path}/log")


@dataclass(frozen=True)
class Consumer:
    """A consumer of a landed log: what it does with a micro-batch, how many files of the log it takes at once, and the
    slice of the log it joined at, whose rows and all later ones it gets."""

    name: str
    sink: Sink
    files: int = 1
    joined_at: int = 0


def fan_out_log(spark: SparkSession, log: str, schema: str, consumers: Sequence[Consumer], path: str) -> dict[str, StreamingQuery]:
    """Start a query for each consumer over one log, a folder with a folder ``slice=<number>`` for each of its slices.

    Each has a checkpoint and a pace of its own: none waits for another, and one that fails or stops goes on later where
    it was. The log keeps what slow consumers still need; a late joiner's older slices are not read.
    """
    started = {}
    for consumer in consumers:
        rows = frame_stream_scan(spark, log, f"{schema}, slice int", max_files=consumer.files).where(F.col("slice") >= consumer.joined_at)
        writer = rows.writeStream.queryName(f"{consumer.name}-{uuid.uuid4().hex}").foreachBatch(consumer.sink)
        started[consumer.name] = writer.option("checkpointLocation", f"{path}/{consumer.name}").trigger(availableNow=True).start()
    return started

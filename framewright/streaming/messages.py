"""Streaming forms of the message and host operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.scalar import utf16_length
from framewright.operators import messages as ms
from framewright.streaming import keyed as kd
from framewright.streaming.runner import replay_to_table

_LONG, _TEXT, _TIME = T.LongType(), T.StringType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def stream_chunk_streams(log: DataFrame, path: str | None = None) -> DataFrame:
    """Substreams of a role-marked log as they end; the state per connection is its open stream."""
    rows = log.select("conn", "ts", "event_id", "role", utf16_length(F.col("payload")).cast("bigint").alias("units"))
    out = _struct(
        ("conn", log.schema["conn"].dataType), ("stream", _LONG), ("opened_by", _TEXT), ("n_rows", _LONG),
        ("total", _LONG), ("status", _TEXT), ("ts", _TIME), ("event_id", _LONG),
    )
    step = kd.ChunkStreams()
    return kd.run_keyed(rows, ["conn"], step, out, step.state, kd.fresh(log.sparkSession, path, "chunks"))


def stream_chunk_total(log: DataFrame, path: str | None = None) -> DataFrame:
    """Size replies as their streams complete."""
    return ms.size_replies(stream_chunk_streams(log, path)).select("conn", "stream", "total", "reply")


def stream_failure_breaker(
    failures: DataFrame, max_failures: int, period: str, path: str | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """Host drops: the time of every ``max_failures``-th failure of a host within a recovery period.

    A failure of a period that the watermark, the latest time less ``delay``, has passed is late: Spark drops it and
    counts it in the query's progress (numRowsDroppedByWatermark).
    """
    timed = failures.select("host", "event_id", F.col("ts").alias("at"), F.col("ts").cast("timestamp").alias("ts"))
    framed = timed.withWatermark("ts", delay).withColumn("_w", F.window("ts", period))
    start, end = F.col("_w.start").cast("timestamp_ntz"), F.unix_millis("_w.end")
    keyed = framed.select("host", "event_id", "at", "ts", start.alias("start"), end.alias("end_ms"))
    out = _struct(("host", failures.schema["host"].dataType), ("window_start", _TIME), ("down_ts", _TIME), ("nth", _LONG))
    step = kd.FailureBreaker(max_failures)
    path = kd.fresh(failures.sparkSession, path, "breaker")
    return kd.run_keyed(keyed, ["host", "start"], step, out, step.state, path, watermark=True)


def stream_request_reply(
    log: DataFrame, path: str | None = None, close_after: str = "4 seconds", delay: str = "0 seconds"
) -> DataFrame:
    """Commands as they are answered, first in first out, or fail.

    ``log`` is the union of both streams with ``side`` = ``cmd`` or ``reply``; rows of another side only carry time on.
    When a connection has had no row for ``close_after``, by the latest time less ``delay``, it closes and its unanswered
    commands fail. Rows later than ``delay`` are dropped and counted.
    """
    out = _struct(
        ("conn", log.schema["conn"].dataType), ("seq", _LONG), ("cmd_id", _LONG), ("cmd_ts", _TIME),
        ("reply_id", _LONG), ("reply_ts", _TIME), ("status", _TEXT), ("reason", _TEXT),
    )
    spark = log.sparkSession
    patience = spark.range(1).select(F.expr(f"timestampdiff(MILLISECOND, timestamp_seconds(0), timestamp_seconds(0) + interval {close_after})")).first()[0]
    rows = log.select("conn", F.col("ts").cast("timestamp").alias("ts"), "event_id", "side").withWatermark("ts", delay)
    answered = kd.processed(rows, ["conn"], kd.RequestReply(patience), out)
    return replay_to_table(answered, kd.fresh(spark, path, "replies")).select(*out.names)

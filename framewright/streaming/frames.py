"""Streaming forms of the frame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators import frames as fr
from framewright.operators.batching import collect_batches
from framewright.streaming import keyed as kd
from framewright.streaming.runner import latest_per_key, replay_to_table


def stream_frame_counters(frames: DataFrame, path: str | None = None, key: str = "device") -> DataFrame:
    """Running counters per client, updated by each micro-batch; the latest value of each."""
    return latest_per_key(replay_to_table(fr.client_frame_counters(frames, key), path, "update"), key)


def stream_throttle(
    frames: DataFrame, period_seconds: float, burst: int, path: str | None = None, key: str = "device"
) -> DataFrame:
    """Paced frames; the state of a client is its frame count and running maximum. Nothing is dropped."""
    fields = [*frames.schema.fields, T.StructField("n", T.LongType()), T.StructField("emit_ts", T.TimestampNTZType())]
    step = kd.Throttle(period_seconds, burst)
    dealt = kd.in_lanes(frames, F.col(key))
    return kd.run_keyed(dealt, ["_lane"], step, T.StructType(fields), step.state, kd.fresh(frames.sparkSession, path, "throttle"))


#: Times inside a batch keep their microseconds.
_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def grouped_batches(frames: DataFrame, size: int, window: str, key: str = "device", delay: str = "0 seconds") -> DataFrame:
    """A stream of batches, each at most ``size`` frames of one client within one time window, numbered in the window.

    Full batches leave at once, what else waits when the watermark, the latest time less ``delay``, passes the window's end;
    that needs no later frame of the client. Frames that come after their window has closed are dropped and counted.
    """
    spark = frames.sparkSession
    width = spark.range(1).select(F.expr(f"timestampdiff(MICROSECOND, timestamp_seconds(0), timestamp_seconds(0) + interval {window})")).first()[0]
    rest = [c for c in frames.columns if c not in (key, "ts", "event_id")]
    payload = F.struct("ts", "event_id", *rest)
    slim = frames.select(key, F.col("ts").cast("timestamp").alias("ts"), "event_id", F.to_json(payload, _JSON).alias("payload"))
    dealt = kd.in_lanes(slim.withWatermark("ts", delay), F.col(key)).drop(key)
    fields = [
        T.StructField(key, T.StringType()),
        T.StructField("window_start", T.TimestampNTZType()),
        T.StructField("batch", T.LongType()),
        T.StructField("frames", T.StringType()),
    ]
    step = kd.GroupedWithin(key, size, width)
    batches = kd.keyed(dealt, ["_lane"], step, T.StructType(fields), step.state, watermark=True)
    kind = f"array<{frames.select(payload.alias('p')).schema['p'].dataType.simpleString()}>"
    batches = batches.withColumn("frames", F.from_json("frames", kind, _JSON))
    client = F.col(key).cast(frames.schema[key].dataType).alias(key)
    return batches.select(client, "window_start", "batch", F.size("frames").cast("bigint").alias("n"), "frames")


def stream_grouped_within(
    frames: DataFrame, size: int, window: str, path: str | None = None, key: str = "device", delay: str = "0 seconds"
) -> DataFrame:
    """The batches of ``grouped_batches`` as a table."""
    path = kd.fresh(frames.sparkSession, path, "grouped")
    return replay_to_table(grouped_batches(frames, size, window, key, delay), path).drop("batch_id")


def stream_grouped_within_timer(frames: DataFrame, size: int, seconds: float, path: str | None = None) -> DataFrame:
    """Batches of a stream; the frames of one batch may come in several micro-batches."""
    slim = frames.select("device", "ts", "event_id")
    step = kd.TimedBatches(size, seconds)
    out = T.StructType([*kd._fields(slim, "device", "ts", "event_id"), T.StructField("batch", T.LongType())])
    numbered = kd.run_keyed(slim, ["device"], step, out, step.state, kd.fresh(frames.sparkSession, path, "timer"))
    return collect_batches(numbered)

"""Frame streams as tables: envelopes, batches, pacing, motion filter, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.arrays import count_nonzero
from framewright.functions.scalar import from_micros, micros
from framewright.operators.ordering import KeyedScan, with_group_index

MOTION_THRESHOLD = 5000  # fixed value: foreground pixels that count as motion


def frame_envelope(frames: DataFrame, client_uuid: Column) -> DataFrame:
    """Stamp each frame with its client and, where the device gave none, the capture time."""
    return frames.withColumn("ts", F.coalesce("ts", F.localtimestamp())).withColumn("client_uuid", client_uuid)


def frame_seq_flatten(messages: DataFrame, frames: str = "frames") -> DataFrame:
    """One row per frame of a frame-sequence message; an empty sequence gives none."""
    others = [c for c in messages.columns if c != frames]
    return messages.select(*others, F.posexplode(frames).alias("pos", "frame"))


def motion_filter(frames: DataFrame, mask: str = "mask", threshold: int = MOTION_THRESHOLD) -> DataFrame:
    """Keep frames whose mask has strictly more than ``threshold`` foreground pixels."""
    return frames.where(count_nonzero(F.col(mask)) > threshold).drop(mask)


def client_frame_counters(frames: DataFrame, key: str = "device") -> DataFrame:
    """Frame count, latest frame time and latest frame id per client."""
    return frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.max("ts").alias("last_ts"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event_id"),
    )


def first_frame(frames: DataFrame, key: str = "device") -> DataFrame:
    """The readiness probe: first frame per client."""
    order = F.struct("ts", "event_id")
    return frames.groupBy(key).agg(
        F.min("ts").alias("first_ts"), F.min_by("event_id", order).alias("first_event_id")
    )


def throttle(
    frames: DataFrame,
    period_seconds: float = 1 / 30,
    burst: int = 1,
    key: str = "device",
    hot_rows: int | None = None,
) -> DataFrame:
    """Token-bucket pacing: every frame leaves, at most one per period after a burst.

    With n the 0-based index of a frame, d the period and B the burst, a frame leaves at
    ``max(ts, (n + 1 - B) * d + max over frames so far of (ts - n * d))``, so the sequential
    bucket becomes a running count and a running maximum.
    """
    paced = throttle_from(frames, None, period_seconds, burst, key, hot_rows)
    return paced.select(*frames.columns, "n", "emit_ts")


def throttle_from(
    frames: DataFrame,
    seed: DataFrame | None,
    period_seconds: float,
    burst: int,
    key: str = "device",
    hot_rows: int | None = None,
) -> DataFrame:
    """:func:`throttle` continued from a ``seed`` (per key: last ``ts`` and ``event_id``, ``n``, ``peak``).

    A seed row enters the log as the key's earlier frames rolled into one. For a split key the
    chunk-local index is too small by n0, which shifts the local maximum by ``-n0 * d``.
    """
    d = round(period_seconds * 1e9)
    log = frames.withColumns(
        {"seeded": F.lit(False), "_weight": F.lit(1).cast("bigint"), "_peak_in": F.lit(None).cast("bigint")}
    )
    if seed is not None:
        earlier = seed.select(
            key,
            "ts",
            "event_id",
            F.lit(True).alias("seeded"),
            (F.col("n") + 1).alias("_weight"),
            F.col("peak").alias("_peak_in"),
        )
        log = log.unionByName(earlier, allowMissingColumns=True)
    scan = KeyedScan(log, [key], ["ts", "event_id"], hot_rows, frames)
    ns = micros(F.col("ts")) * 1000
    rows = scan.rows.withColumn("_n", F.sum("_weight").over(scan.running) - 1)
    rows = rows.withColumn("_lead", F.coalesce("_peak_in", ns - F.col("_n") * d))
    rows = rows.withColumn("_peak", F.max("_lead").over(scan.running))

    def earlier_chunks(chunks, before):
        with_n0 = chunks.withColumn("_n0", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
        return with_n0.withColumn("_peak0", F.max(F.col("_top") - F.col("_n0") * d).over(before))

    rows = scan.carry(
        rows,
        [F.sum("_weight").alias("_cnt"), F.max("_lead").alias("_top")],
        earlier_chunks,
        {"_n0": F.lit(0).cast("bigint"), "_peak0": F.lit(None).cast("bigint")},
    )
    rows = rows.withColumn("n", F.col("_n") + F.col("_n0"))
    rows = rows.withColumn("peak", F.greatest("_peak0", F.col("_peak") - F.col("_n0") * d))
    rows = rows.withColumn("_emit", F.greatest(ns, (F.col("n") + 1 - burst) * d + F.col("peak")))
    return rows.select(
        *frames.columns, "n", "peak", "seeded", from_micros(F.expr("_emit div 1000")).alias("emit_ts")
    )


def grouped_within(
    frames: DataFrame,
    size: int = 5,
    window: str = "1 second",
    key: str = "device",
    hot_rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Batches of at most ``size`` frames of one client within one time window, in frame order."""
    start = F.window("ts", window)["start"]
    keyed = frames.withColumn("window_start", start)
    if counted is not None:
        counted = counted.withColumn("window_start", start)
    indexed = with_group_index(
        keyed, [key, "window_start"], ["ts", "event_id"], "_i", hot_rows, counted=counted
    )
    payload = F.struct("ts", "event_id", *[c for c in frames.columns if c not in (key, "ts", "event_id")])
    return (
        indexed.groupBy(key, "window_start", F.floor(F.col("_i") / size).cast("bigint").alias("batch"))
        .agg(F.sort_array(F.collect_list(payload)).alias("frames"))
        .withColumn("n", F.size("frames").cast("bigint"))
    )


def quarantine(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Tag each row with the first failed check (null = good), so the stream goes on."""
    error = F.lit(None).cast("string")
    for reason, failed in reversed(list(checks.items())):
        error = F.when(F.coalesce(failed, F.lit(True)), reason).otherwise(error)
    return df.withColumn("error", error)


def drop_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """All rows but the first ``n`` in order, without sorting the rest: only rows up to the n-th key are left out.

    ``order`` must be unique. A table of at most ``n`` rows gives none.
    """
    if n <= 0:
        return df
    key = F.struct(*order)
    last = df.select(key.alias("_key")).orderBy("_key").limit(n).agg(F.count("*").alias("n"), F.max("_key").alias("k"))
    bound = F.when(F.col("n") == n, F.col("k"))
    return df.where(key > last.select(bound).scalar())


def take_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows in order (a top-n, not a sort of everything)."""
    return df.orderBy(*order).limit(n)

"""Queries over frames: envelopes, filters, batches, pacing, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import frames as fr
from framewright.operators.batching import grouped_within_timer
from framewright.plans import fixtures as fx
from framewright.plans.fixtures import with_views
from framewright.plans.registry import query


@query(
    "frame_envelope",
    with_views(
        f"""SELECT device, ts, event_id, {fx.UUID_SQL.format('device')} AS client_uuid FROM frames""", "frames"
    ),
)
def frame_envelope(spark, sf_dir):
    stamped = fr.frame_envelope(fx.frames(spark, sf_dir), fx.client_uuid(F.col("device")))
    return stamped.select("device", "ts", "event_id", "client_uuid")


_BATCHES_SQL = """
    WITH numbered AS (
      SELECT *, date_trunc('day', ts) AS window_start,
        row_number() OVER (PARTITION BY device, date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS rn
      FROM frames)"""


def frame_batches(spark, sf_dir):
    return fr.grouped_within(fx.frames(spark, sf_dir), fx.BATCH_SIZE, fx.BATCH_WINDOW)


@query(
    "grouped_within",
    with_views(
        _BATCHES_SQL
        + """
    SELECT device, window_start, CAST(rn // 5 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n,
      min(ts) AS first_ts, max(ts) AS last_ts, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS ids
    FROM numbered GROUP BY device, window_start, rn // 5""",
        "frames",
    ),
)
def grouped_within(spark, sf_dir):
    return frame_batches(spark, sf_dir).select(
        "device",
        "window_start",
        "batch",
        "n",
        F.col("frames")[0]["ts"].alias("first_ts"),
        F.element_at("frames", -1)["ts"].alias("last_ts"),
        F.array_join(F.col("frames.event_id").cast("array<string>"), ",").alias("ids"),
    )


# one step per frame of a client, for all clients at once; 43,200,000,000 us = 12 h
TIMED_BATCHES_SQL = (
    "WITH RECURSIVE "
    + with_views(
        """WITH numbered AS (
      SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS rn FROM frames),
    walk AS (
      SELECT device, rn, ts, event_id, us, 0 AS batch, 1 AS held, us + 43200000000 AS deadline, 0 AS open_batch
      FROM numbered WHERE rn = 1
      UNION ALL
      SELECT device, rn, ts, event_id, us, batch, CASE WHEN held0 = 4 THEN 0 ELSE held0 + 1 END,
        CASE WHEN held0 = 4 THEN us + 43200000000 ELSE deadline0 END, CASE WHEN held0 = 4 THEN batch + 1 ELSE batch END
      FROM (
        SELECT n.device, n.rn, n.ts, n.event_id, n.us,
          CASE WHEN n.us >= w.deadline AND w.held > 0 THEN w.open_batch + 1 ELSE w.open_batch END AS batch,
          CASE WHEN n.us >= w.deadline THEN 0 ELSE w.held END AS held0,
          CASE WHEN n.us >= w.deadline THEN w.deadline + ((n.us - w.deadline) // 43200000000 + 1) * 43200000000
               ELSE w.deadline END AS deadline0
        FROM walk w JOIN numbered n ON n.device = w.device AND n.rn = w.rn + 1) stepped)
    SELECT device, CAST(batch AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
      string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM walk GROUP BY device, batch""",
        "frames",
    ).removeprefix("WITH ")
)


def batch_summary(batches):
    return batches.select(
        "device",
        "batch",
        "n",
        F.col("frames")[0]["ts"].alias("first_ts"),
        F.element_at("frames", -1)["ts"].alias("last_ts"),
        F.array_join(F.col("frames.event_id").cast("array<string>"), ",").alias("ids"),
    )


@query("grouped_within_timer", TIMED_BATCHES_SQL)
def timed(spark, sf_dir):
    return batch_summary(grouped_within_timer(fx.frames(spark, sf_dir), fx.BATCH_SIZE, fx.BATCH_TIMER))


@query(
    "frame_seq_flatten",
    with_views(
        _BATCHES_SQL
        + """
    SELECT device, window_start, CAST(rn // 5 AS BIGINT) AS batch, CAST(rn % 5 AS INTEGER) AS pos, ts, event_id
    FROM numbered""",
        "frames",
    ),
)
def frame_seq_flatten(spark, sf_dir):
    flat = fr.frame_seq_flatten(frame_batches(spark, sf_dir))
    return flat.select("device", "window_start", "batch", "pos", F.col("frame.ts"), F.col("frame.event_id"))


@query(
    "motion_filter",
    with_views("SELECT vec_id, label FROM masks WHERE list_sum(mask) > 15", "emb", "masks"),
)
def motion_filter(spark, sf_dir):
    return fr.motion_filter(fx.masks(spark, sf_dir), threshold=fx.MASK_THRESHOLD)


@query(
    "quarantine_bad_rows",
    with_views(
        """SELECT event_id, conn,
          CASE WHEN tag NOT IN (1, 2, 3, 4) THEN 'unknown tag' WHEN coalesce(payload, '') = '' THEN 'empty payload'
               WHEN try_cast(regexp_extract(payload, '([0-9]+)', 1) AS INTEGER) % 10 = 0 THEN 'bad value' END AS error,
          CASE WHEN tag IN (1, 2, 3, 4) AND coalesce(payload, '') <> ''
               THEN try_cast(regexp_extract(payload, '([0-9]+)', 1) AS INTEGER) ELSE -1 END AS k
        FROM msgs""",
        "msgs",
    ),
)
def quarantine_bad_rows(spark, sf_dir):
    value = F.regexp_extract("payload", "([0-9]+)", 1).try_cast("int")
    parsed = fx.messages(spark, sf_dir).withColumn("k", value)
    checked = fr.quarantine(
        parsed,
        {
            "unknown tag": ~F.col("tag").isin(1, 2, 3, 4),
            "empty payload": F.coalesce("payload", F.lit("")) == "",
            "bad value": F.col("k") % 10 == 0,
        },
    )
    usable = F.col("error").isNull() | (F.col("error") == "bad value")
    return checked.select("event_id", "conn", "error", F.when(usable, F.col("k")).otherwise(-1).alias("k"))


@query(
    "client_frame_counters",
    with_views(
        """SELECT device, CAST(count(*) AS BIGINT) AS n_frames, max(ts) AS last_ts,
          arg_max(event_id, (ts, event_id)) AS last_event_id FROM frames GROUP BY device""",
        "frames",
    ),
)
def client_frame_counters(spark, sf_dir):
    return fr.client_frame_counters(fx.frames(spark, sf_dir))


@query(
    "first_frame",
    with_views(
        """SELECT device, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_event_id
        FROM frames GROUP BY device""",
        "frames",
    ),
)
def first_frame(spark, sf_dir):
    return fr.first_frame(fx.frames(spark, sf_dir))


THROTTLE_SQL = with_views(
    """WITH numbered AS (
      SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) - 1 AS n, epoch_us(ts) AS us FROM frames),
    peaks AS (
      SELECT *, max(us - n * 72000000000) OVER (
        PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM numbered)
    SELECT device, event_id, ts, CAST(n AS BIGINT) AS n,
      make_timestamp(greatest(us, (n + 1 - 3) * 72000000000 + peak)) AS emit_ts FROM peaks""",
    "frames",
)


@query("throttle", THROTTLE_SQL)
def throttle(spark, sf_dir):
    paced = fr.throttle(fx.frames(spark, sf_dir), fx.THROTTLE_PERIOD, fx.THROTTLE_BURST)
    return paced.select("device", "event_id", "ts", "n", "emit_ts")


@query(
    "take_n",
    with_views(
        """SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, device, event_id, ts
        FROM frames QUALIFY idx < 50""",
        "frames",
    ),
)
def take_n(spark, sf_dir):
    first = fr.take_n(fx.frames(spark, sf_dir), 50, "ts", "event_id")
    rows = F.sort_array(F.collect_list(F.struct("ts", "event_id", "device")))
    # the list holds the 50 rows just taken
    return first.agg(rows.alias("rows")).select(F.posexplode("rows").alias("idx", "r")).select(
        F.col("idx").cast("bigint").alias("idx"), "r.device", "r.event_id", "r.ts"
    )


@query(
    "drop_n",
    with_views(
        """SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, device, event_id, ts
        FROM frames QUALIFY idx >= 50""",
        "frames",
    ),
)
def drop_n(spark, sf_dir):
    from framewright.operators.ordering import with_global_index

    indexed = with_global_index(fx.frames(spark, sf_dir), ["ts", "event_id"])
    return indexed.where(F.col("idx") >= 50).select("idx", "device", "event_id", "ts")

"""Streaming twins: the given table replayed as a stream, checked by the batch query's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators import frames as fr
from framewright.plans import fixtures as fx
from framewright.plans.fixtures import with_views
from framewright.plans.frame_queries import THROTTLE_SQL, TIMED_BATCHES_SQL, batch_summary
from framewright.plans.message_queries import CHUNK_TOTAL_SQL
from framewright.plans.registry import ORACLES, query
from framewright.plans.session_queries import GATE_SQL, HISTORY_SQL, known_ids
from framewright.session import open_filesystem, work_path
from framewright.sources.frames import frame_stream_scan
from framewright.sources.grabs import frame_grabs, grab_counts
from framewright.streaming import frames as sf
from framewright.streaming import messages as sm
from framewright.streaming import sessions as ss
from framewright.streaming.runner import dropped_rows, replay_stopping, replay_to_table, run, write_batch

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


#: Rows of a landed file, about.
FILE_ROWS = 4_000_000
#: How far behind the newest row a group of devices may land: half of the table's thirty days, and some.
DELAY = "16 days"
#: The last event's window, a day at most, ends within this.
WINDOW_DELAY = "17 days"
#: No connection is silent for so long; so all are open until the closing row.
PATIENCE = "40 days"


def land(rows: DataFrame, groups: Column | None = None, delay: str | None = None) -> str:
    """Write a table as the files of a stream and return their folder.

    First comes a file whose only row has no time, so a micro-batch that is empty once filtered. Then the
    rows in time order: without ``groups`` in three slices, with it in two halves of a slice for either group. Each
    key's rows stay in time order, which is the order that the SQL assumes; between keys they do not. With a
    ``delay`` the last file has one row of type ``tick``, so much later than the last event that nothing waits any more.
    A slice is a file for every FILE_ROWS rows of it.
    """
    path = work_path(rows.sparkSession, "landed")
    first, last, n = rows.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    files = [rows.limit(1).select(nothing)]
    parts = 3 if groups is None else 2
    for i in range(parts):
        part = rows
        if i > 0:
            part = part.where(F.col("ts") >= first + i * (last - first) / parts)
        if i < parts - 1:
            part = part.where(F.col("ts") < first + (i + 1) * (last - first) / parts)
        files += [part] if groups is None else [part.where(groups), part.where(~groups)]
    if delay is not None:
        later = F.lit(last).cast("timestamp_ntz") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 MILLISECOND")
        tick = {"ts": later, "event_id": F.lit(-1).cast("bigint"), "event_type": F.lit("tick")}
        files.append(files[0].withColumns({c: v for c, v in tick.items() if c in rows.columns}))
    for i, file in enumerate(files):
        share = n // (len(files) * FILE_ROWS) + 1 if 0 < i else 1
        file.repartition(share).write.mode("append").parquet(path)
    return path


def events_stream(spark, sf_dir, in_order=False, delay=None):
    """The events as a stream of one file a micro-batch; two device groups take turns unless ``in_order``."""
    groups = None if in_order else F.col("user_id") % 2 == 0
    path = land(fx.table(spark, sf_dir, "events"), groups, delay)
    return frame_stream_scan(spark, path, EVENTS_SCHEMA, ("ts", "event_id"), max_files=1)


@query(
    "frame_stream_scan",
    with_views(
        """SELECT device, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts
        FROM frames GROUP BY device""",
        "frames",
    ),
)
def frame_stream_scan_query(spark, sf_dir):
    landed = replay_to_table(fx.frames_view(events_stream(spark, sf_dir)))
    return landed.groupBy("device").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


#: Slices of grabs that land; each has one grab that failed.
GRAB_SLICES = 3


def land_grabs(rows: DataFrame) -> str:
    """Write a table as slices of grabs and return their folder.

    Every slice also has a row without a time, as an empty grab leaves it, and a file that breaks off, as a
    failed one does.
    """
    path = work_path(rows.sparkSession, "grabs")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    empty = rows.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    for i in range(GRAB_SLICES):
        part = rows.where(F.col("ts") >= first + i * (last - first) / GRAB_SLICES)
        if i < GRAB_SLICES - 1:
            part = part.where(F.col("ts") < first + (i + 1) * (last - first) / GRAB_SLICES)
        part.unionByName(empty).write.parquet(f"{path}/{i:06d}")
        filesystem, base = open_filesystem(f"{path}/{i:06d}")
        with filesystem.open_output_stream(f"{base}/failed.parquet") as out:
            out.write(b"PAR1 breaks off")
    return path


@query(
    "frame_grab_scan",
    with_views(
        f"""SELECT device, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
          CAST({GRAB_SLICES} AS BIGINT) AS empty, CAST({GRAB_SLICES} AS BIGINT) AS failed FROM frames GROUP BY device""",
        "frames",
    ),
)
def frame_grab_scan(spark, sf_dir):
    """The frames of a source some of whose grabs fail, and how many did."""
    grabs = frame_grabs(spark, land_grabs(fx.table(spark, sf_dir, "events")), EVENTS_SCHEMA, ("ts", "event_id"))
    path = work_path(spark, "grabbed")
    counts: dict[str, int] = {}
    writer = fx.frames_view(grabs).writeStream.foreachBatch(lambda batch, i: write_batch(batch, f"{path}/out", i))
    run(writer, f"{path}/checkpoint", lambda query: counts.update(grab_counts(query)))
    return (
        spark.read.parquet(f"{path}/out")
        .groupBy("device")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .withColumns({name: F.lit(counts[name]).cast("bigint") for name in ("empty", "failed")})
    )


@query(
    "stream_frame_counters",
    ORACLES["client_frame_counters"],
)
def stream_frame_counters(spark, sf_dir):
    return sf.stream_frame_counters(fx.frames_view(events_stream(spark, sf_dir)))


@query("stream_throttle", THROTTLE_SQL)
def stream_throttle(spark, sf_dir):
    frames = fx.frames_view(events_stream(spark, sf_dir))
    return sf.stream_throttle(frames, fx.THROTTLE_PERIOD, fx.THROTTLE_BURST).drop("value")


@query(
    "stream_grouped_within",
    ORACLES["grouped_within"],
)
def stream_grouped_within(spark, sf_dir):
    frames = fx.frames_view(events_stream(spark, sf_dir, delay=WINDOW_DELAY))
    batches = sf.stream_grouped_within(frames, fx.BATCH_SIZE, fx.BATCH_WINDOW, delay=DELAY)
    return batches.select(
        "device",
        "window_start",
        "batch",
        "n",
        F.col("frames")[0]["ts"].alias("first_ts"),
        F.element_at("frames", -1)["ts"].alias("last_ts"),
        F.array_join(F.col("frames.event_id").cast("array<string>"), ",").alias("ids"),
    )


@query("stream_grouped_within_timer", TIMED_BATCHES_SQL)
def stream_grouped_within_timer(spark, sf_dir):
    frames = fx.frames_view(events_stream(spark, sf_dir))
    return batch_summary(sf.stream_grouped_within_timer(frames, fx.BATCH_SIZE, fx.BATCH_TIMER))


@query("stream_session_machine", HISTORY_SQL)
def stream_session_machine(spark, sf_dir):
    events = fx.session_events_view(events_stream(spark, sf_dir, delay=DELAY))
    return ss.stream_session_machine(events, fx.SESSION_TIMEOUT, delay=DELAY)


@query("stream_session_gate", GATE_SQL)
def stream_session_gate(spark, sf_dir):
    events = fx.session_events_view(events_stream(spark, sf_dir, delay=DELAY))
    return ss.stream_session_gate(events, fx.SESSION_TIMEOUT, fx.CHECK_DELAY, delay=DELAY)


@query("stream_chunk_total", CHUNK_TOTAL_SQL)
def stream_chunk_total(spark, sf_dir):
    return sm.stream_chunk_total(fx.chunk_log_view(events_stream(spark, sf_dir)))


@query("stream_failure_breaker", ORACLES["host_failure_breaker"])
def stream_failure_breaker(spark, sf_dir):
    failures = fx.host_failures_view(events_stream(spark, sf_dir))
    return sm.stream_failure_breaker(failures, fx.BREAKER_MAX, fx.BREAKER_WINDOW, delay=DELAY)


@query(
    "stream_late_failures",
    with_views(
        """WITH placed AS (
          SELECT host, ts, event_id * 3 // (SELECT max(event_id) + 1 FROM events) AS third FROM host_ev)
        SELECT CAST(count(*) FILTER (WHERE third = 0) AS BIGINT) AS late, CAST(count(*) FILTER (WHERE third > 0) AS BIGINT) AS in_time
        FROM placed""",
        "host_ev",
    ),
)
def stream_late_failures(spark, sf_dir):
    """Three slices that land newest first, without any delay allowed: what the watermark drops is counted.

    The watermark that a micro-batch's rows are held against is the one before it, so the second slice is still in time.
    """
    events, path = fx.table(spark, sf_dir, "events"), work_path(spark, "late")
    ids = events.agg(F.max("event_id")).first()[0] + 1
    for third in (2, 1, 0):
        part = events.where(F.floor(F.col("event_id") * 3 / ids) == third)
        part.coalesce(1).write.mode("append").parquet(f"{path}/landed")
    failures = fx.host_failures_view(frame_stream_scan(spark, f"{path}/landed", EVENTS_SCHEMA, ("ts",), max_files=1))
    sm.stream_failure_breaker(failures, fx.BREAKER_MAX, fx.BREAKER_WINDOW, path)
    late, seen = dropped_rows(spark, path), fx.host_failures(spark, sf_dir).agg(F.count("*").alias("n"))
    return seen.select(F.lit(late).cast("bigint").alias("late"), (F.col("n") - late).alias("in_time"))


def two_sided(events):
    commands = fx.commands_view(events).select("conn", "ts", "event_id", F.lit("cmd").alias("side"))
    return commands.unionByName(fx.replies_view(events).withColumn("side", F.lit("reply")))


@query(
    "stream_request_reply",
    with_views(
        """WITH c AS (SELECT conn, event_id AS cmd_id, ts AS cmd_ts,
            row_number() OVER (PARTITION BY conn ORDER BY ts, event_id) - 1 AS seq FROM cmds),
          r AS (SELECT conn, event_id AS reply_id, ts AS reply_ts,
            row_number() OVER (PARTITION BY conn ORDER BY ts, event_id) - 1 AS seq FROM replies)
        SELECT c.conn, CAST(c.seq AS BIGINT) AS seq, cmd_id, cmd_ts, coalesce(reply_id, -1) AS reply_id, reply_ts,
          CASE WHEN reply_id IS NULL THEN 'failed' ELSE 'answered' END AS status,
          CASE WHEN reply_id IS NULL THEN 'ConnectionClosed' END AS reason
        FROM c LEFT JOIN r ON c.conn = r.conn AND c.seq = r.seq""",
        "cmds",
        "replies",
    ),
)
def stream_request_reply(spark, sf_dir):
    path = land(two_sided(fx.table(spark, sf_dir, "events")), F.col("conn") % 2 == 0, "57 days")
    schema = "conn bigint, ts timestamp_ntz, event_id bigint, side string"
    log = frame_stream_scan(spark, path, schema, ("ts",), max_files=1)
    return known_ids(sm.stream_request_reply(log, close_after=PATIENCE, delay=DELAY))


@query(
    "stream_resume",
    ORACLES["client_frame_counters"],
)
def stream_resume(spark, sf_dir):
    """A run that stops in mid-stream, one that goes on to the end, and one that must add nothing."""
    path, events = work_path(spark, "resume"), events_stream(spark, sf_dir)
    counters = fr.client_frame_counters(fx.frames_view(events))
    replay_stopping(counters, lambda b, i: write_batch(b, f"{path}/out", i), f"{path}/checkpoint", 2, "update")
    sf.stream_frame_counters(fx.frames_view(events), path)
    return sf.stream_frame_counters(fx.frames_view(events), path)

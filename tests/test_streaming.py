"""Replays over several micro-batches must equal the batch operator over the whole table."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from compare import spark_rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from framewright.operators import background as bg
from framewright.operators import frames as fr
from framewright.operators import hosts as ho
from framewright.operators import messages as ms
from framewright.operators import sessions as se
from framewright.operators.batching import grouped_within_timer
from framewright.plans import fixtures as fx
from framewright.plans.model_queries import video_bytes
from framewright.plans.stream_queries import EVENTS_SCHEMA, land, two_sided
from framewright.session import work_path
from framewright.sources.frames import frame_stream_scan
from framewright.sources import notifications
from framewright.sources.sinks import Consumer, fan_out_log, fan_out_sinks, notification_messages, notification_sink
from framewright.streaming import frames as sf
from framewright.streaming import messages as sm
from framewright.streaming import sessions as ss
from framewright.streaming.background import stream_background_subtraction
from framewright.streaming.runner import dropped_rows, replay, replay_stopping, replay_to_table, run

SLICES = 4


def write_tick(df, path):
    """A last file with one row, so much later that nothing waits."""
    last = df.agg(F.max("ts")).first()[0]
    row = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    values = {"ts": F.lit(last + dt.timedelta(days=60)).cast("timestamp_ntz"), "event_id": F.lit(-1).cast("bigint"), "event_type": F.lit("tick")}
    df.limit(1).select(row).withColumns({c: v for c, v in values.items() if c in df.columns}).write.mode("append").parquet(path)


def write_slices(df, path, first=0, last=SLICES, by="ts"):
    """Land a table as files in time order, one write each."""
    low, high = df.agg(F.min(by), F.max(by)).first()
    step = (high - low) / SLICES
    for i in range(first, last):
        part = df.where(F.col(by) >= low + i * step)
        if i < SLICES - 1:
            part = part.where(F.col(by) < low + (i + 1) * step)
        part.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").where("user_id < 40").cache()


@pytest.fixture(scope="module")
def landed(spark, events):
    path = work_path(spark, "landed")
    write_slices(events, path)
    return path


@pytest.fixture(scope="module")
def closed(spark, events):
    """As ``landed``, with a row at the end that carries time on."""
    path = work_path(spark, "closed")
    write_slices(events, path)
    write_tick(events, path)
    return path


@pytest.fixture
def closing(spark, closed):
    return frame_stream_scan(spark, closed, EVENTS_SCHEMA, ("ts",), max_files=1)


@pytest.fixture
def stream(spark, landed):
    return frame_stream_scan(spark, landed, EVENTS_SCHEMA, ("ts",), max_files=1)


def same(actual, expected):
    assert spark_rows(actual) == spark_rows(expected.select(*actual.columns))


def test_several_batches(stream):
    assert replay_to_table(stream).select("batch_id").distinct().count() == SLICES


def test_frame_counters(stream, events):
    same(sf.stream_frame_counters(fx.frames_view(stream)), fr.client_frame_counters(fx.frames_view(events)))


def test_throttle(stream, events):
    expected = fr.throttle(fx.frames_view(events), fx.THROTTLE_PERIOD, fx.THROTTLE_BURST)
    same(sf.stream_throttle(fx.frames_view(stream), fx.THROTTLE_PERIOD, fx.THROTTLE_BURST), expected)


@pytest.mark.parametrize("window", ["1 day", "10 days"])
def test_grouped_within(closing, events, window):
    frames = fx.frames_view(events)
    expected = fr.grouped_within(frames, 3, window)
    actual = sf.stream_grouped_within(fx.frames_view(closing), 3, window, delay="1 day")
    columns = ["device", "window_start", "batch", "n", F.to_json("frames").alias("frames")]
    same(actual.select(*columns), expected.select(*columns))


def test_grouped_within_timer(stream, events):
    expected = grouped_within_timer(fx.frames_view(events), 3, 30 * 3600.0)
    actual = sf.stream_grouped_within_timer(fx.frames_view(stream), 3, 30 * 3600.0)
    columns = ["device", "batch", "n", F.to_json("frames").alias("frames")]
    same(actual.select(*columns), expected.select(*columns))


def test_session_machine(closing, events):
    expected = se.session_history(fx.session_events_view(events), fx.SESSION_TIMEOUT)
    last = events.agg(F.max("ts")).first()[0]
    assert expected.where("kind = 'timer'").count() > 0
    found = ss.stream_session_machine(fx.session_events_view(closing), fx.SESSION_TIMEOUT)
    same(found.where(F.col("ts") <= last), expected)


@pytest.mark.parametrize("delay_days", [1 / 24, 9])
def test_session_gate(closing, events, delay_days):
    delay = delay_days * 86400.0
    expected = se.session_gate(fx.session_events_view(events), fx.SESSION_TIMEOUT, delay)
    found = ss.stream_session_gate(fx.session_events_view(closing), fx.SESSION_TIMEOUT, delay)
    same(found, expected)
    passed, dropped = ss.gate_outputs(found)
    assert passed.count() == expected.where("passed").count() and dropped.count() == expected.where("not passed").count()


def test_chunk_total(stream, events):
    same(sm.stream_chunk_total(fx.chunk_log_view(stream)), ms.chunk_stream_total(fx.chunk_log_view(events)))


def test_chunk_streams_continue_across_batches(stream, events):
    """Every ended stream, also anonymous and aborted ones, keeps its id, rows and total."""
    expected = ms.chunk_streams(ms.chunk_stream_ids(ms.chunk_rows(fx.chunk_log_view(events))))
    rows = sm.stream_chunk_streams(fx.chunk_log_view(stream))
    columns = ["conn", "stream", "opened_by", "n_rows", "total", "status"]
    ended = "status <> 'unfinished'"
    same(rows.where(ended).select(*columns), expected.where(ended).select(*columns))


def test_failure_breaker(stream, events):
    same(sm.stream_failure_breaker(fx.host_failures_view(stream), 2, "3 days"), ho.host_failure_breaker(fx.host_failures_view(events), 2, "3 days"))


def test_request_reply(spark, events):
    log = two_sided(events)
    path = work_path(spark, "two-sided")
    write_slices(log, path)
    write_tick(log, path)
    arriving = frame_stream_scan(spark, path, "conn bigint, ts timestamp_ntz, event_id bigint, side string", max_files=1)
    expected = ho.request_reply_fifo(fx.commands_view(events), fx.replies_view(events))
    same(sm.stream_request_reply(arriving, close_after="50 days"), expected)


def test_background_subtraction(stream, events):
    frames = video_bytes(fx.video_view(events))
    expected = bg.foreground_pixels(bg.background_subtraction(frames, 16, 8))
    same(stream_background_subtraction(video_bytes(fx.video_view(stream)), 16, 8), expected)


def test_resume_from_checkpoint(spark, events):
    """Stop after two files, land the rest, go on: same result as one run."""
    path, state = work_path(spark, "resume-in"), work_path(spark, "resume")

    def run():
        arriving = frame_stream_scan(spark, path, EVENTS_SCHEMA, ("ts",), max_files=1)
        return sf.stream_throttle(fx.frames_view(arriving), fx.THROTTLE_PERIOD, fx.THROTTLE_BURST, state)

    write_slices(events, path, 0, 2)
    assert run().count() < events.count()
    write_slices(events, path, 2, SLICES)
    expected = fr.throttle(fx.frames_view(events), fx.THROTTLE_PERIOD, fx.THROTTLE_BURST)
    same(run(), expected)
    assert run().count() == events.count()


def test_nothing_is_dropped(spark, events):
    """Two device groups in turns, the older rows in the later file, after a file that is empty once filtered."""
    path = land(events, F.col("user_id") % 2 == 0)
    arriving = frame_stream_scan(spark, path, EVENTS_SCHEMA, ("ts",), max_files=1)
    expected = fr.throttle(fx.frames_view(events), fx.THROTTLE_PERIOD, fx.THROTTLE_BURST)
    same(sf.stream_throttle(fx.frames_view(arriving), fx.THROTTLE_PERIOD, fx.THROTTLE_BURST), expected)
    log = fx.chunk_log_view
    same(sm.stream_chunk_total(log(arriving)), ms.chunk_stream_total(log(events)))


def test_sessions_of_sources_in_turns(spark, events):
    """Groups of devices whose files take turns, within the delay, cut where sessions and windows are open."""
    path = land(events, F.col("user_id") % 2 == 0, "17 days")
    arriving = frame_stream_scan(spark, path, EVENTS_SCHEMA, ("ts",), max_files=1)
    expected = se.session_history(fx.session_events_view(events), fx.SESSION_TIMEOUT)
    last = events.agg(F.max("ts")).first()[0]
    found = ss.stream_session_machine(fx.session_events_view(arriving), fx.SESSION_TIMEOUT, delay="16 days")
    same(found.where(F.col("ts") <= last), expected)


def test_late_rows_are_counted(spark, events):
    path, state = work_path(spark, "late-in"), work_path(spark, "late")
    last = events.agg(F.max("ts")).first()[0]
    recent, old = events.where(F.col("ts") > last - dt.timedelta(days=5)), events.where(F.col("ts") < last - dt.timedelta(days=20))
    for part in (recent, recent.limit(1), old):
        part.coalesce(1).write.mode("append").parquet(path)
    arriving = frame_stream_scan(spark, path, EVENTS_SCHEMA, max_files=1)
    ss.stream_session_machine(fx.session_events_view(arriving), fx.SESSION_TIMEOUT, state)
    assert dropped_rows(spark, state) == old.count() > 0


def test_stops_in_mid_stream(spark, stream):
    path, seen = work_path(spark, "stops"), []
    assert replay_stopping(stream, lambda b, i: seen.append(i), f"{path}/plain", 3) == 3 and seen == [0, 1, 2]
    replay(stream, lambda b, i: seen.append(i), f"{path}/plain")
    assert seen == [0, 1, 2, 3]
    assert replay_stopping(stream, lambda b, i: seen.append(i), f"{path}/plain", 2) == 0
    assert seen == [0, 1, 2, 3]


def test_notifications_over_micro_batches(spark, events):
    """Landings that cut days at noon give the batches of one landing."""
    frames = fx.frames_view(events).withColumn("ts", F.col("ts") + F.expr("INTERVAL 12 HOURS"))
    path = work_path(spark, "noon")
    write_slices(frames, path)
    write_tick(frames, path)
    arriving = frame_stream_scan(spark, path, "device bigint, ts timestamp_ntz, event_id bigint, value double", ("ts",), max_files=1)
    found = notification_sink(arriving, work_path(spark, "sent"), fx.client_uuid(F.col("device")), 5, "1 day", "1 day")
    expected = notification_messages(frames, fx.client_uuid(F.col("device")), 5, "1 day")
    same(found.select("conn", "window_start", "batch"), expected.select("conn", "window_start", "batch"))
    assert found.select("data").distinct().count() == expected.count()


def test_failed_send_leaves_no_half_batch(spark):
    path = work_path(spark, "failing")
    notifications.register(spark)
    kind = "conn bigint, window_start timestamp_ntz, batch bigint, data binary"
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(i, at, 0, bytearray(b"x")) for i in range(40)], kind).coalesce(1).write.parquet(f"{path}/in")
    bad = spark.createDataFrame([(100 + i, at, 0, None if i == 33 else bytearray(b"y")) for i in range(40)], kind)
    bad.coalesce(1).write.mode("append").parquet(f"{path}/in")

    def send(rows):
        rows = rows.repartition(4)
        run(rows.writeStream.format("notification_log").option("path", f"{path}/log").outputMode("append"), f"{path}/checkpoint")

    arriving = frame_stream_scan(spark, f"{path}/in", kind, max_files=1)
    with pytest.raises(StreamingQueryException):
        send(arriving)
    assert notifications.sent_notifications(spark, f"{path}/log").count() == 40
    assert list(notifications.failed_sends(f"{path}/log")) == [1]
    send(arriving.withColumn("data", F.coalesce("data", F.lit(b"late"))))
    sent = notifications.sent_notifications(spark, f"{path}/log")
    assert sent.count() == sent.select("conn").distinct().count() == 80


def test_consumers_at_their_own_pace(spark, events):
    """A slow sink and one that fails hold nobody up; who joins late gets what follows."""
    path = work_path(spark, "paces")
    sliced = events.withColumn("slice", (F.col("event_id") % 4).cast("int"))
    for i in range(4):
        sliced.where(F.col("slice") == i).drop("slice").coalesce(1).write.parquet(f"{path}/log/slice={i}")
    seen, ended = {"fast": 0, "slow": 0, "late": 0, "broken": 0}, []

    def sink(name, wait=0.0):
        def take(batch, batch_id):
            time.sleep(wait)
            seen[name] += batch.count()
            ended.append(name)
            if name == "broken":
                raise ValueError("out of order")

        return take

    consumers = [Consumer("slow", sink("slow", 3.0)), Consumer("fast", sink("fast"), 4), Consumer("late", sink("late"), 1, 2), Consumer("broken", sink("broken"))]
    running = fan_out_log(spark, f"{path}/log", EVENTS_SCHEMA, consumers, f"{path}/checkpoints")
    for name in ("fast", "late", "slow"):
        running[name].awaitTermination()
    assert running["broken"].exception() is not None
    n = events.count()
    assert seen["fast"] == seen["slow"] == n and seen["late"] == events.where("event_id % 4 >= 2").count()
    assert ended.index("fast") < len(ended) - 1 - ended[::-1].index("slow") and ended[-1] == "slow"


def test_fan_out_copies_everything(spark, stream, events):
    copies = fan_out_sinks(stream, work_path(spark, "fan"), 2)
    for copy in copies:
        same(copy.drop("batch_id"), events)

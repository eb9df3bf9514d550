"""Operators against plain sequential Python models on small fixtures."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from compare import spark_rows
from pyspark.sql import functions as F

from framewright.operators import background as bg
from framewright.operators import dataset as ds
from framewright.operators import frames as fr
from framewright.operators import framing as fm
from framewright.operators import handlers as ha
from framewright.operators import hosts as ho
from framewright.operators import messages as ms
from framewright.operators import scoring as so
from framewright.operators import sessions as se
from framewright.operators.batching import grouped_within_timer
from framewright.operators.images import bilinear
from framewright.operators.ordering import seeded_order, with_global_index, with_group_index
from framewright.plans.model_queries import conv_layers

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def skewed(n, keys=4, seed=0):
    """(key, second, id): key 0 holds a third of the rows and more; times may tie."""
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0, 0, 0.01, 0.2, 1.5])
        rows.append((0 if rng.random() < 0.4 else rng.randrange(keys), t, i))
    return rows


@pytest.fixture(params=[None, 7], ids=["whole keys", "split keys"])
def hot_rows(request):
    return request.param


def test_throttle_is_a_token_bucket(spark, hot_rows):
    rows = skewed(400)
    frames = spark.createDataFrame([(k, at(t), i) for k, t, i in rows], "device int, ts timestamp_ntz, event_id bigint")
    period, burst = 0.25, 3
    expected, last_leave, bucket = {}, {}, {}
    for k, t, i in rows:
        # tokens refill one per period up to the burst; a frame waits for its token
        tokens, when = bucket.get(k, (burst, t))
        now = max(t, last_leave.get(k, t))
        tokens = min(burst, tokens + (now - when) / period)
        wait = max(0.0, (1 - tokens) * period)
        leave = now + wait
        bucket[k] = (min(burst, tokens + wait / period) - 1, leave)
        last_leave[k] = leave
        expected[i] = leave
    got = {r.event_id: (r.emit_ts - START).total_seconds() for r in fr.throttle(frames, period, burst, hot_rows=hot_rows).collect()}
    assert got.keys() == expected.keys()
    assert max(abs(got[i] - expected[i]) for i in got) < 1e-5


def test_group_and_global_index(spark, hot_rows):
    rows = [(None if k == 3 else k, t, i) for k, t, i in skewed(300)]
    df = spark.createDataFrame(rows, "k int, t double, id bigint")
    expected, counts = {}, {}
    for k, _, i in sorted(rows, key=lambda r: (r[1], r[2])):
        expected[i] = counts.get(k, 0)
        counts[k] = expected[i] + 1
    got = with_group_index(df, ["k"], ["t", "id"], hot_rows=hot_rows)
    assert {r.id: r.idx for r in got.collect()} == expected
    places = {r.id: r.idx for r in with_global_index(df.repartition(5), ["t", "id"]).collect()}
    assert places == {i: n for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


def sequential_streams(log):
    """The substream machine, message by message."""
    done, current, ids = [], {}, {}
    for conn, ts, eid, role, payload in log:
        here = current.get(conn)
        if here is None:
            if role in "OC":
                ids[conn] = ids.get(conn, 0) + 1
                current[conn] = {"conn": conn, "stream": ids[conn], "by": role, "total": len(payload), "n": 1}
        elif role == "C":
            here["total"] += len(payload)
            here["n"] += 1
        else:
            done.append({**current.pop(conn), "status": "completed" if role == "T" else "aborted", "n": here["n"] + 1})
    done += [{**s, "status": "unfinished"} for s in current.values()]
    return sorted((s["conn"], s["stream"], s["by"], s["n"], s["total"], s["status"]) for s in done)


def test_chunk_streams(spark, hot_rows):
    rng = random.Random(5)
    log = [(k, at(t), i, rng.choice("OCCCTX"), "x" * rng.randrange(1, 9)) for k, t, i in skewed(500, seed=2)]
    df = spark.createDataFrame(log, "conn int, ts timestamp_ntz, event_id bigint, role string, payload string")
    streams = ms.chunk_streams(ms.chunk_stream_ids(ms.chunk_rows(df), hot_rows))
    got = streams.select("conn", "stream", "opened_by", "n_rows", "total", "status").collect()
    assert sorted(map(tuple, got)) == sequential_streams(log)


def test_payload_length_counts_utf16_units(spark):
    log = [(1, at(0), 0, "O", "a"), (1, at(1), 1, "C", "\U0001f600é"), (1, at(2), 2, "T", "")]
    df = spark.createDataFrame(log, "conn int, ts timestamp_ntz, event_id bigint, role string, payload string")
    assert [r.total for r in ms.chunk_stream_total(df).collect()] == [4]


def sequential_sessions(events, timeout):
    """The session keeper, event by event, with its timers."""
    sessions, timers, out = {}, [], []
    end = max(e[1] for e in events)

    def fire(until, strict):
        for due, addr in sorted(timers):
            if (due < until if strict else due <= until) and due <= end:
                timers.remove((due, addr))
                if sessions[addr][1] is None:
                    sessions[addr] = ("Expired", None)
                out.append((addr, due, -1, *sessions[addr]))

    for addr, ts, eid, kind, device in events:
        fire(ts, strict=True)
        known = addr in sessions
        if kind == "new" and not known:
            sessions[addr] = ("Init", None)
            timers.append((ts + dt.timedelta(seconds=timeout), addr))
        elif kind == "resolve" and known and device:
            sessions[addr] = ("Active", device)
        elif kind == "reset" and known:
            sessions[addr] = ("Expired", None)
        if addr in sessions:
            out.append((addr, ts, eid, *sessions[addr]))
    fire(end, strict=False)
    return sorted(out)


def session_log(seed, n=400):
    rng = random.Random(seed)
    kinds = ["new", "resolve", "resolve", "reset", "message", "message"]
    log = []
    for k, t, i in skewed(n, keys=12, seed=seed):
        kind = rng.choice(kinds)
        device = f"d{i}" if kind == "resolve" and rng.random() < 0.7 else None
        log.append((k, at(t), i, kind, device))
    return log


SESSION_SCHEMA = "addr int, ts timestamp_ntz, event_id bigint, kind string, device_id string"


def test_session_history(spark, hot_rows):
    log = session_log(3)
    got = se.session_history(spark.createDataFrame(log, SESSION_SCHEMA), 5.0, hot_rows)
    rows = got.select("addr", "ts", "event_id", "state", "session_device").collect()
    assert sorted(map(tuple, rows)) == sequential_sessions(log, 5.0)


def test_session_snapshot_is_the_last_history_row(spark, hot_rows):
    log = session_log(4)
    events = spark.createDataFrame(log, SESSION_SCHEMA)
    probes = spark.createDataFrame([(k,) for k in range(20)], "addr int")
    last = {}
    for addr, ts, eid, state, device in sorted(sequential_sessions(log, 5.0), key=lambda r: (r[1], r[2] < 0, r[2])):
        last[addr] = (state, device)
    got = {r.addr: (r.state, r.session_device) for r in se.session_snapshot(events, probes, 5.0, hot_rows).collect()}
    assert got == {k: last.get(k, ("Expired", None)) for k in range(20)}


def test_session_gate(spark, hot_rows):
    log = session_log(6)
    states = {}
    for addr, ts, eid, state, _ in sorted(sequential_sessions(log, 5.0), key=lambda r: (r[1], r[2] < 0, r[2])):
        states.setdefault(addr, []).append((ts, state))
    expected, known, reply = {}, set(), {}
    for addr, ts, eid, kind, device in log:
        if kind in ("new", "reset"):
            known |= {addr} if kind == "new" else set()
            continue
        if addr not in known:
            continue
        if addr not in reply:
            if kind == "resolve" and device:
                reply[addr] = ts
                expected[eid] = "consumed"
            else:
                expected[eid] = "malformed uuid" if kind == "resolve" else "initialising"
            continue
        probe = reply[addr] + dt.timedelta(seconds=1)
        if ts <= probe:
            expected[eid] = "checking"
        else:
            state = [s for t, s in states[addr] if t <= probe][-1]
            expected[eid] = None if state == "Active" else "expired"
    got = se.session_gate(spark.createDataFrame(log, SESSION_SCHEMA), 5.0, 1.0, hot_rows)
    assert {r.event_id: r.drop_reason for r in got.collect()} == expected


def test_request_reply_is_a_queue(spark, hot_rows):
    rows = skewed(200, seed=8)
    commands = [(k, at(t), i) for k, t, i in rows]
    replies = [(k, at(t + 0.5), i) for k, t, i in rows if i % 3]
    schema = "conn int, ts timestamp_ntz, event_id bigint"
    got = ho.request_reply_fifo(spark.createDataFrame(commands, schema), spark.createDataFrame(replies, schema), hot_rows=hot_rows)
    queues = {}
    for k, _, i in commands:
        queues.setdefault(k, []).append(i)
    expected = {i: None for _, _, i in commands}
    for k, _, i in sorted(replies, key=lambda r: (r[1], r[2])):
        expected[queues[k].pop(0)] = i
    assert {r.cmd_id: r.reply_id for r in got.collect()} == expected


def test_failure_breaker(spark, hot_rows):
    rows = skewed(200, seed=9)
    got = ho.host_failure_breaker(
        spark.createDataFrame([(k, at(t), i) for k, t, i in rows], "host int, ts timestamp_ntz, event_id bigint"),
        3, "4 seconds", hot_rows,
    )
    expected, counts = [], {}
    for k, t, _ in rows:
        period = (k, int(t // 4))
        counts[period] = counts.get(period, 0) + 1
        if counts[period] == 3:
            expected.append((k, at(t)))
            counts[period] = 0
    assert sorted((r.host, r.down_ts) for r in got.collect()) == sorted(expected)


def test_subscriptions(spark):
    rng = random.Random(1)
    log = [(k, at(t), i, rng.choice(["add", "remove"])) for k, t, i in skewed(80, keys=12)]
    active = set()
    for k, _, _, op in log:
        (active.add if op == "add" else active.discard)(k)
    got = ho.active_subscriptions(spark.createDataFrame(log, "key int, ts timestamp_ntz, event_id bigint, op string"))
    assert {r.key for r in got.collect()} == active


def sequential_mixture(frames, p):
    """The mixture update for one pixel, component by component."""
    comps, masks = [], []
    for x in frames:
        heavier, background = 0.0, False
        for w, m, v in comps:
            if heavier < p.background_ratio and (x - m) ** 2 < p.threshold * v:
                background = True
            heavier += w
        masks.append(0 if background else 1)
        owner = next((j for j, (w, m, v) in enumerate(comps) if (x - m) ** 2 < p.generation_threshold * v), None)
        updated = []
        for j, (w, m, v) in enumerate(comps):
            w = (1 - p.learning_rate) * w - p.learning_rate * p.complexity
            if j == owner:
                w += p.learning_rate
                k, d = min(p.learning_rate / w, 1.0), x - m
                m, v = m + k * d, min(max(v + k * (d * d - v), p.min_variance), p.max_variance)
            if w > 0:
                updated.append((w, m, v))
        if owner is None:
            if len(updated) == p.components:
                updated.remove(min(updated, key=lambda c: c[0]))
            updated.append((p.learning_rate, float(x), p.initial_variance))
        total = sum(w for w, _, _ in updated)
        comps = sorted(((w / total, m, v) for w, m, v in updated), key=lambda c: -c[0])
    return masks


def test_mixture_model_per_pixel(spark):
    rng = np.random.default_rng(3)
    n, pixels = 60, 6
    video = np.clip(rng.normal(100, 3, (n, pixels)), 0, 255).astype(np.uint8)
    video[rng.random((n, pixels)) < 0.15] = 220
    rows = [(1, at(i), i, bytearray(video[i].tobytes())) for i in range(n)]
    frames = spark.createDataFrame(rows, "device bigint, ts timestamp_ntz, event_id bigint, data binary")
    got = bg.background_subtraction(frames.repartition(3), pixels, 4).collect()
    masks = np.full((n, pixels), -1)
    for r in got:
        masks[r.event_id, r.tile * 4 : r.tile * 4 + len(r.mask)] = np.frombuffer(bytes(r.mask), dtype=np.uint8)
    params = bg.MixtureParams()
    expected = np.array([sequential_mixture(video[:, j].astype(float), params) for j in range(pixels)]).T
    assert (masks == expected).all()
    assert 0 < expected.mean() < 1


def test_bilinear_resize():
    image = np.random.default_rng(0).integers(0, 256, (2, 5, 7, 3)).astype(float)
    got = bilinear(image, 9, 4)
    for y in range(9):
        for x in range(4):
            sy, sx = y * 5 / 9, x * 7 / 4
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, 4), min(x0 + 1, 6)
            fy, fx = sy - y0, sx - x0
            top = image[:, y0, x0] * (1 - fx) + image[:, y0, x1] * fx
            bottom = image[:, y1, x0] * (1 - fx) + image[:, y1, x1] * fx
            assert np.allclose(got[:, y, x], top * (1 - fy) + bottom * fy)


def test_conv_stack():
    images = np.random.default_rng(1).random((3, 8, 8, 1))
    layers = conv_layers()
    conv = layers[0]
    expected = np.zeros((3, 6, 6, 4))
    for y in range(6):
        for x in range(6):
            for o in range(4):
                expected[:, y, x, o] = (images[:, y : y + 3, x : x + 3, 0] * conv.kernel[:, :, 0, o]).sum(axis=(1, 2))
    assert np.allclose(conv(images), expected)
    pooled = so.MaxPool(2)(expected)
    assert pooled.shape == (3, 3, 3, 4) and np.allclose(pooled[:, 1, 2], expected[:, 2:4, 4:6].max(axis=(1, 2)))
    assert so.run_layers(layers, images).shape == (3, 10)


def test_split_frames_at_any_cut(spark, hot_rows):
    rng = random.Random(2)
    rows, expected = [], []
    for conn in range(4):
        n = 60 if conn == 0 else 12
        bodies = [rng.randbytes(rng.randrange(0, 40)) for _ in range(n)]
        expected += [(conn, i, b) for i, b in enumerate(bodies)]
        data = b"".join(len(b).to_bytes(4, "big") + b for b in bodies)
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(40))})
        rows += [(conn, i, bytearray(data[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    df = spark.createDataFrame(rows, "conn int, seq int, data binary")
    got = fm.split_frames(df, hot_rows=hot_rows).collect()
    assert sorted((r.conn, r.msg, bytes(r.wire)) for r in got) == sorted(expected)
    assert all(r.error is None for r in got)


def test_split_frames_reports_bad_logs(spark):
    good = (2).to_bytes(4, "big") + b"ok"
    rows = [
        (1, 0, bytearray(good + (50).to_bytes(4, "big") + b"never sent")),
        (2, 0, bytearray(good + (1 << 30).to_bytes(4, "big"))),
        (2, 1, bytearray(b"after the fault")),
    ]
    got = fm.split_frames(spark.createDataFrame(rows, "conn int, seq int, data binary")).collect()
    assert sorted((r.conn, r.msg, r.error or "") for r in got) == [
        (1, 0, ""), (1, 1, "truncated"), (2, 0, ""), (2, 1, "too long"),
    ]


def test_decode_quarantines_bad_messages(spark):
    rows = [(0, bytearray(b"\x00\x00\x00\x02hi")), (1, bytearray(b"\x00\x00\x00\x0bmap")), (2, bytearray(b"\x00\x00")),
            (3, bytearray(b"\x00\x00\x00\x01\x00")), (4, bytearray(b"\xff\xff\xff\xff"))]
    df = spark.createDataFrame(rows, "id int, wire binary")
    server = {r.id: (r.payload, r.error) for r in ms.decode_messages(df).collect()}
    assert server == {0: ("hi", None), 1: (None, "unknown tag"), 2: (None, "short message"),
                      3: (None, "short message"), 4: (None, "unknown tag")}
    client = {r.id: r.body for r in ms.decode_messages(df, ms.CLIENT_TAGS).collect()}
    assert client[1] == "map"


def test_label_map_must_fit_a_message(spark):
    labels = spark.range(3).select(F.col("id").cast("int"), F.expr("repeat('x', 2000000)").alias("display_name"))
    assert ms.label_map_reply(labels).first().asDict() == {"labels": None, "error": "too long"}
    assert ms.label_map_reply(labels.limit(2)).first().error is None


def test_handler_sees_each_key_once_and_in_order(spark):
    rows = [(k, t, i) for k, t, i in skewed(300, seed=4)]
    df = spark.createDataFrame(rows, "k int, t double, id bigint").repartition(6)

    def first_ids(key, batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"k": [key[0]], "id": [batch["id"].iloc[0]]})
            return  # the rest of the key is left unread

    got = ha.handler_process_stream(df, ["k"], ["t", "id"], first_ids, "k int, id bigint")
    expected = {}
    for k, _, i in sorted(rows, key=lambda r: (r[1], r[2])):
        expected.setdefault(k, i)
    assert sorted(map(tuple, got.collect())) == sorted(expected.items())


def test_merge_eager_ends_with_the_first_input(spark):
    a = spark.createDataFrame([(at(t), t) for t in (1, 5, 9)], "ts timestamp_ntz, v int")
    b = spark.createDataFrame([(at(t), t) for t in (2, 6)], "ts timestamp_ntz, v int")
    assert [r[1] for r in spark_rows(ms.merge_streams_eager(a, b))[1]] == [1, 2, 5, 6]


@pytest.mark.parametrize("sizes", [{0: 900, 1: 40, 2: 300}, {0: 10, 1: 10}, {0: 5000, None: 3}])
def test_balanced_sample_takes_the_first_of_each_class(spark, hot_rows, sizes):
    rows = [(n * 10_000 + i, label) for n, (label, size) in enumerate(sizes.items()) for i in range(size)]
    samples = spark.createDataFrame(rows, "id bigint, label int")
    k = min(sizes.values())
    expected = set()
    for label in sizes:
        ids = sorted((i for i, c in rows if c == label), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
        expected |= {(i, label, n) for n, i in enumerate(ids[:k])}
    got = ds.balanced_sample(samples, 7, hot_rows and 400)
    assert {(r.id, r.label, r.idx) for r in got.collect()} == expected


def test_balanced_sample_shuffles_only_likely_rows(spark):
    samples = spark.range(20_000).select("id", F.when(F.col("id") < 100, 0).otherwise(1).alias("label"))
    keyed = samples.withColumn("_key", seeded_order(0, "id"))
    assert ds._likely_first(keyed, 100).count() < 500
    even = keyed.withColumn("label", (F.col("id") % 2).cast("int"))
    assert ds._likely_first(even, 10_000) is even


def test_percent_split_drops_the_remainder(spark):
    samples = spark.range(33).select("id", (F.col("id") % 3).cast("int").alias("label"))
    got = ds.percent_split(samples, (70, 0, 20)).groupBy("label", "dataset").count().collect()
    assert sorted(map(tuple, got)) == [(c, d, n) for c in range(3) for d, n in (("test", 2), ("train", 7))]


def test_timer_batches(spark):
    rows = skewed(300, seed=11)
    frames = spark.createDataFrame([(k, at(t), i) for k, t, i in rows], "device int, ts timestamp_ntz, event_id bigint")
    expected, held, fires = [], {}, {}
    for k, t, i in rows:
        us = round(t * 1e6)
        fires.setdefault(k, us + 1_000_000)
        while us >= fires[k]:  # every firing in between, also the idle ones
            if held.get(k):
                expected.append((k, held.pop(k)))
            fires[k] += 1_000_000
        held.setdefault(k, []).append(i)
        if len(held[k]) == 3:
            expected.append((k, held.pop(k)))
            fires[k] = us + 1_000_000
    expected += list(held.items())
    got = grouped_within_timer(frames.repartition(4), 3, 1.0).collect()
    assert sorted((r.device, [f.event_id for f in r.frames]) for r in got) == sorted(expected)

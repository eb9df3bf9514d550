"""Steps of the keyed streaming operators over random cuts, against sequential models; no stream is needed."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from test_models import at, sequential_streams

from framewright.streaming import keyed as kd


class State:
    """Stands for Spark's state of one key."""

    def __init__(self):
        self.value, self.timeout, self.watermark, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark

    def setTimeoutTimestamp(self, ms):  # noqa: N802
        assert ms >= self.watermark
        self.timeout = ms


def watched(make, rows, key, rng, delay):
    """The output of a step over random micro-batches of all keys, with a watermark and timers as Spark has them."""
    edges = [0, *sorted(rng.sample(range(1, len(rows) - 1), 6)), len(rows) - 1, len(rows), len(rows)]
    states, out, top, before, watermark = {}, [], None, 0, 0
    for a, z in zip(edges, edges[1:]):
        batch = [r for r in rows[a:z] if r["ts"].value // 1000 > before * 1000]
        assert len(batch) == z - a, "a row was late"
        groups = {}
        for r in batch:
            groups.setdefault(r[key], []).append(r)
        for k in {*groups, *states}:
            state = states.setdefault(k, State())
            state.watermark, state.hasTimedOut = watermark, k not in groups
            if state.hasTimedOut:
                if not state.exists or state.timeout is None or state.timeout >= watermark:
                    continue
            state.timeout = None
            out += list(make()((k,), iter([pd.DataFrame(groups[k])] if k in groups else []), state))
        top = max([r["ts"].value // 1_000_000 for r in rows[a:z]] + ([] if top is None else [top]))
        before, watermark = watermark, max(watermark, top - delay // 1000)
    return pd.concat(out, ignore_index=True)


def run(step, rows, cuts, key=(7,)):
    """The output rows of a step over micro-batches of ``rows`` (dicts in arrival order)."""
    state, out = State(), []
    for a, z in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        if a < z:
            out += [f for f in step(key, iter([pd.DataFrame(rows[a:z])]), state)]
    return pd.concat(out, ignore_index=True), state


def log(rng, n=60):
    return [{"ts": pd.Timestamp(at(t)), "event_id": i} for i, t in enumerate(sorted(rng.choices(range(40), k=n)))]


def cuts(rng, n):
    return sorted(rng.sample(range(1, n), 4))


@pytest.mark.parametrize("seed", range(5))
def test_throttle(seed):
    rng = random.Random(seed)
    rows = log(rng)
    out, _ = run(kd.Throttle(0.5, 2), rows, cuts(rng, len(rows)))
    emitted, top = [], None
    for n, r in enumerate(rows):
        ns = r["ts"].value
        top = max(x for x in (top, ns - n * 500_000_000) if x is not None)
        emitted.append(max(ns, (n + 1 - 2) * 500_000_000 + top) // 1000)
    assert out["n"].tolist() == [str(i) for i in range(len(rows))]
    assert kd._us(out["emit_ts"]).tolist() == emitted


@pytest.mark.parametrize("seed", range(8))
def test_chunk_streams(seed):
    rng = random.Random(seed)
    rows = [r | {"role": rng.choice("OCCCTX"), "units": str(rng.randrange(1, 9))} for r in log(rng)]
    out, _ = run(kd.ChunkStreams(), rows, cuts(rng, len(rows)))
    model = [(7, r["ts"].to_pydatetime(), r["event_id"], r["role"], "x" * int(r["units"])) for r in rows]
    expected = [s[1:] for s in sequential_streams(model) if s[-1] != "unfinished"]
    got = [(int(r.stream), r.opened_by, int(r.n_rows), int(r.total), r.status) for r in out.itertuples()]
    assert sorted(got) == sorted(expected)


class Handle:
    """Stands for a processor's states and timers of one key, and counts what is written."""

    def __init__(self):
        self.timers, self.value, self.map, self.writes = set(), None, {}, 0
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getValueState(self, *_):  # noqa: N802
        self_ = self

        class Value:
            exists = staticmethod(lambda: self_.value is not None)
            get = staticmethod(lambda: self_.value)

            @staticmethod
            def update(value):
                self_.value = value

        return Value

    def getMapState(self, *_):  # noqa: N802
        self_ = self

        class Map:
            getValue = staticmethod(lambda k: self_.map[k])
            clear = staticmethod(lambda: self_.map.clear())

            @staticmethod
            def updateValue(k, v):  # noqa: N802
                self_.map[k] = v
                self_.writes += 1

            @staticmethod
            def removeKey(k):  # noqa: N802
                del self_.map[k]
                self_.writes += 1

        return Map


@pytest.mark.parametrize("seed", range(8))
def test_request_reply(seed):
    """What waits is written once and taken once, however long the queue is; closing fails what is left."""
    rng = random.Random(seed)
    rows = [r | {"side": rng.choice(["cmd", "reply"] if seed % 2 else ["cmd", "cmd", "reply"])} for r in log(rng)]
    step, handle, out = kd.RequestReply(60_000), Handle(), []
    step.init(handle)
    for a, z in zip([0, *(edges := cuts(rng, len(rows)))], [*edges, len(rows)], strict=True):
        handle.writes = 0
        out += list(step.handleInputRows((7,), iter([pd.DataFrame(rows[a:z])]), None))
        assert handle.writes <= z - a
    (due,) = handle.timers
    assert due == rows[-1]["ts"].value // 1_000_000 + 60_000
    out += list(step.handleExpiredTimer((7,), None, None))
    found = {int(r.seq): (int(r.cmd_id), r.reply_id and int(r.reply_id), r.status) for f in out for r in f.itertuples()}
    commands, replies = ([r["event_id"] for r in rows if r["side"] == s] for s in ("cmd", "reply"))
    assert found == {i: (c, *((replies[i], "answered") if i < len(replies) else (None, "failed"))) for i, c in enumerate(commands)}
    assert handle.map == {} and sum(len(f) for f in out) == len(commands)


@pytest.mark.parametrize("seed", range(4))
def test_timed_batches(seed):
    rng = random.Random(seed)
    rows = log(rng)
    cut, _ = run(kd.TimedBatches(3, 4.0), rows, cuts(rng, len(rows)))
    whole, _ = run(kd.TimedBatches(3, 4.0), rows, [])
    assert cut.drop(columns="device").equals(whole.drop(columns="device")) and len(cut) == len(rows)


def test_background():
    rng = np.random.default_rng(1)
    rows = [{"ts": pd.Timestamp(at(t)), "event_id": t, "data": rng.integers(0, 256, 12, np.uint8).tobytes()} for t in range(30)]
    step = kd.Background(kd.MixtureParams())
    assert run(step, rows, [1, 9, 20])[0].equals(run(step, rows, [])[0])


def test_times_are_whole():
    assert at(1) - at(0) == dt.timedelta(seconds=1)

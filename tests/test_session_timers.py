"""Session and window steps under disorder within the delay and random cuts, against sequential models."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from test_keyed import log, watched
from test_models import at, sequential_sessions, session_log

from framewright.streaming import keyed as kd
from framewright.streaming import sessions as ss

DELAY = 6_000_000


def disordered(rng, rows, width=DELAY):
    """Rows in an order in which none comes more than ``width`` microseconds behind a later one."""
    return sorted(rows, key=lambda r: (r["ts"].value // 1000 + rng.randrange(width), r["event_id"]))


def session_rows(seed):
    return [dict(zip(("addr", "ts", "event_id", "kind", "device_id"), r, strict=True)) | {"ts": pd.Timestamp(r[1])} for r in session_log(seed, 200)]


def closing(rows):
    last = max(r["ts"] for r in rows)
    return {"addr": None, "ts": last + pd.Timedelta(DELAY + 1000, unit="us"), "event_id": -1, "kind": ss.TICK, "device_id": None}


@pytest.mark.parametrize("seed", range(6))
def test_session_machine(seed):
    rng, rows = random.Random(seed), session_rows(seed)
    arriving = [*disordered(rng, rows), closing(rows)]
    out = watched(lambda: ss.MachineStep(5.0), arriving, "addr", rng, DELAY)
    got = sorted((r.addr, r.ts.to_pydatetime(), int(r.event_id), r.state, r.session_device) for r in out.itertuples())
    assert got == sequential_sessions([tuple(r[c] for c in ("addr", "ts", "event_id", "kind", "device_id")) for r in rows], 5.0)


def gate_model(rows, timeout, delay):
    """Each address's messages in order, with the session state looked up in the machine's history."""
    history = sequential_sessions([tuple(r[c] for c in ("addr", "ts", "event_id", "kind", "device_id")) for r in rows], timeout)
    out, known, replies = [], {}, {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        addr, kind = r["addr"], r["kind"]
        if addr not in known:
            if kind == "new":
                known[addr] = r["ts"]
            continue
        if kind in ("new", "reset"):
            continue
        reply = kind == "resolve" and r["device_id"] is not None
        if addr not in replies:
            reason = "consumed" if reply else "malformed uuid" if kind == "resolve" else "initialising"
            if reply:
                replies[addr] = r["ts"] + pd.Timedelta(delay, unit="s")
        elif r["ts"] <= replies[addr]:
            reason = "checking"
        else:
            seen = [h for h in history if h[0] == addr and h[1] <= replies[addr]]
            # the timer, event -1, follows the rows of its time
            state = max(seen, key=lambda h: (h[1], h[2] == -1, h[2]))[3]
            reason = None if state == "Active" else "expired"
        out.append((addr, r["event_id"], reason))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("delay", [1.0, 5.0, 12.0])
def test_session_gate(seed, delay):
    rng, rows = random.Random(seed), session_rows(seed)
    out = watched(lambda: ss.GateStep(5.0, delay), [*disordered(rng, rows), closing(rows)], "addr", rng, DELAY)
    got = sorted((r.addr, int(r.event_id), None if r.passed else r.drop_reason) for r in out.itertuples())
    assert got == gate_model(rows, 5.0, delay)


@pytest.mark.parametrize("seed", range(6))
def test_windows_close_without_a_later_frame(seed):
    """Everything leaves, each window's frames in batches of at most three, none waiting for a frame of its client."""
    rng = random.Random(seed)
    rows = [r | {"device": rng.randrange(4), "payload": json.dumps({"event_id": r["event_id"]})} for r in log(rng, 80)]
    last = max(r["ts"] for r in rows)
    tick = {"ts": last + pd.Timedelta(DELAY + 5_000_000, unit="us"), "event_id": -1, "device": 99, "payload": "{}"}
    out = watched(lambda: kd.GroupedWithin("device", 3, 5_000_000), [*disordered(rng, rows), tick], "device", rng, DELAY)
    found = {}
    for r in out.itertuples():
        ids = [f["event_id"] for f in json.loads(r.frames)]
        found.setdefault((r.device, kd._us(pd.Series([r.window_start]))[0]), []).append((int(r.batch), ids))
    expected = {}
    for r in rows:
        expected.setdefault((r["device"], r["ts"].value // 1000 // 5_000_000 * 5_000_000), set()).add(r["event_id"])
    assert {k: set().union(*(ids for _, ids in v)) for k, v in found.items()} == expected
    for batches in found.values():
        batches.sort()
        assert [b for b, _ in batches] == list(range(len(batches)))
        assert [len(ids) for _, ids in batches[:-1]] == [3] * (len(batches) - 1)

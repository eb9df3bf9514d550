"""Streaming forms of the session operators, on Spark's keyed state with event-time timers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.streaming import keyed as kd

#: Rows of this kind only tell that time has reached their ``ts``.
TICK = "tick"

_OUT = [
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("kind", T.StringType()),
]
HISTORY = [*_OUT, T.StructField("state", T.StringType()), T.StructField("session_device", T.StringType())]
VERDICTS = [*_OUT, T.StructField("passed", T.BooleanType()), T.StructField("drop_reason", T.StringType())]


@dataclass
class Session:
    """What is known of one address: its state, the timers that are open, and rows whose time has not come.

    Times are microseconds, ``due`` the resolve timeout, ``probe`` when a reply is checked; None where not set or past.
    """

    state: str | None = None
    device: str | None = None
    due: int | None = None
    probe: int | None = None
    replied: bool = False
    active: bool | None = None
    waiting: list = field(default_factory=list)

    def pack(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def unpack(cls, text: str) -> Session:
        return cls(**json.loads(text))

    def next_time(self) -> int | None:
        """When the session has something to do next."""
        times = [t for t in (self.due, self.probe) if t is not None]
        if self.waiting:
            times.append(min(r[0] for r in self.waiting))
        return min(times, default=None)


class SessionStep:
    """One address's new rows and timers; subclasses say what leaves.

    Rows wait until the watermark has passed them, so they are taken by (ts, event_id) in whatever order they came. A
    timer follows the rows of its own time. The one timeout of the keyed store is set to whatever is due first.
    """

    state = "session string"

    def __init__(self, timeout: float, check_delay: float | None = None):
        self.timeout = round(timeout * 1e6)
        self.check_delay = None if check_delay is None else round(check_delay * 1e6)

    def __call__(self, key, pieces, state):
        session = Session.unpack(state.get[0]) if state.exists else Session()
        if not state.hasTimedOut:
            for piece in pieces:
                piece = piece[piece["kind"] != TICK]
                columns = kd._us(piece["ts"]).tolist(), piece["event_id"].tolist(), piece["kind"].tolist(), piece["device_id"].tolist()
                session.waiting += [list(r) for r in zip(*columns, strict=True)]
        now = state.getCurrentWatermarkMs()
        out = list(self.advance(session, now * 1000))
        upcoming = session.next_time()
        if session.state is None and upcoming is None:
            if state.exists:
                state.remove()
        else:
            state.update((session.pack(),))
            if upcoming is not None:
                kd.timeout_ms(state, upcoming)
        if out:
            yield self.frame(key[0], out)

    def advance(self, session: Session, now: int):
        ready = sorted(r for r in session.waiting if r[0] <= now)
        session.waiting = [r for r in session.waiting if r[0] > now]
        for row in ready:
            yield from self.timers(session, row[0])
            yield from self.row(session, *row)
        yield from self.timers(session, now + 1)

    def timers(self, session: Session, before: int):
        """Fire what is due before a time, the timeout ahead of a check at the same time."""
        while True:
            due, probe = session.due, session.probe
            if due is not None and due < before and (probe is None or due <= probe):
                session.due = None
                if session.state != "Active":
                    session.state, session.device = "Expired", None
                yield from self.timed_out(session, due)
            elif probe is not None and probe < before:
                session.probe, session.active = None, session.state == "Active"
            else:
                return

    def row(self, session: Session, ts: int, event_id: int, kind: str, device: str | None):
        if session.state is None:
            if kind != "new":
                return
            session.state, session.due = "Init", ts + self.timeout
        else:
            yield from self.judged(session, ts, event_id, kind, device)
            if kind == "resolve" and device is not None:
                session.state, session.device = "Active", device
            elif kind == "reset":
                session.state, session.device = "Expired", None
        yield from self.taken(session, ts, event_id, kind)

    def timed_out(self, session, ts):
        return ()

    def judged(self, session, ts, event_id, kind, device):
        return ()

    def taken(self, session, ts, event_id, kind):
        return ()


class MachineStep(SessionStep):
    """Gives the session after each row, and after its timeout."""

    def timed_out(self, session, ts):
        yield ts, -1, "timer", session.state, session.device

    def taken(self, session, ts, event_id, kind):
        yield ts, event_id, kind, session.state, session.device

    def frame(self, addr, out):
        return _frame(addr, out, "state", "session_device")


class GateStep(SessionStep):
    """Gives each message with its verdict: passed, or dropped for a reason."""

    def judged(self, session, ts, event_id, kind, device):
        if kind in ("new", "reset"):
            return
        reply = kind == "resolve" and device is not None
        if not session.replied:
            if reply:
                session.replied, session.probe = True, ts + self.check_delay
                reason = "consumed"
            else:
                reason = "malformed uuid" if kind == "resolve" else "initialising"
        elif session.active is None:
            reason = "checking"
        else:
            reason = None if session.active else "expired"
        yield ts, event_id, kind, reason is None, reason

    def frame(self, addr, out):
        return _frame(addr, out, "passed", "drop_reason")


def _frame(addr, out, *names):
    columns = list(zip(*out, strict=True))
    return pd.DataFrame(
        {
            "addr": [addr] * len(out),
            "ts": kd._times(pd.Series(columns[0], dtype="int64").to_numpy()),
            "event_id": [str(i) for i in columns[1]],
            "kind": pd.Series(columns[2], dtype=object),
            names[0]: pd.Series(columns[3], dtype=object),
            names[1]: pd.Series(columns[4], dtype=object),
        }
    )


def _run(events: DataFrame, step: SessionStep, fields: list[T.StructField], delay: str, path: str | None) -> DataFrame:
    slim = events.select("addr", F.col("ts").cast("timestamp").alias("ts"), "event_id", "kind", "device_id")
    out = T.StructType([*kd._fields(events, "addr"), *fields])
    path = kd.fresh(events.sparkSession, path, "sessions")
    return kd.run_keyed(slim.withWatermark("ts", delay), ["addr"], step, out, step.state, path, watermark=True)


def stream_session_machine(events: DataFrame, timeout: float, path: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Session history. A timeout fires when the stream's time, the latest ``ts`` less ``delay``, has passed it.

    Rows leave once the stream's time has passed them, in whatever order they came; later ones than ``delay`` are
    dropped and counted (``late_rows``). A row of kind ``tick`` is no event: it only carries time on, so that what waits
    at the end leaves too.
    """
    return _run(events, MachineStep(timeout), HISTORY, delay, path)


def stream_session_gate(
    events: DataFrame, timeout: float, check_delay: float, path: str | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """Messages with their verdict; time, late rows and ticks as for the machine.

    The check of a reply is a timer of its own, behind the timeout where both are due at once.
    """
    return _run(events, GateStep(timeout, check_delay), VERDICTS, delay, path)


def gate_outputs(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a gate lets through, and what it drops with the reason."""
    columns = ["addr", "ts", "event_id", "kind"]
    return judged.where("passed").select(*columns), judged.where("not passed").select(*columns, "drop_reason")

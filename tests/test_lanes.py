"""A step takes a lane of clients in one call, and gives what each client alone would get."""

from __future__ import annotations

import numpy as np
import pandas as pd

from framewright.operators.background import MixtureParams, PixelMixture
from framewright.streaming import keyed as kd

START = pd.Timestamp("2024-01-01")


class State:
    """A state as Spark hands it to a step."""

    def __init__(self, watermark: int = 0):
        self.value, self.watermark, self.hasTimedOut, self.timer = None, watermark, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark

    def setTimeoutTimestamp(self, ms):  # noqa: N802
        self.timer = ms


def _rows(clients, seconds, **columns):
    ts = [START + pd.Timedelta(seconds=s) for s in seconds]
    return pd.DataFrame({"_client": clients, "_lane": "0", "ts": ts, "event_id": range(len(ts)), **columns})


def test_background_lane():
    random, params, state = np.random.default_rng(1), MixtureParams(), State()
    step, alone = kd.Background(params), {}
    for batch in range(3):
        clients = random.choice(["0:1", "1:1", "0:2", "0", "0:7"][: 3 + batch], 40).tolist()
        data = [random.integers(0, 4, 8).astype(np.uint8) * 60 for _ in clients]
        rows = _rows(clients, range(40), device=clients, data=[d.tobytes() for d in data])
        (found,) = step(("0",), iter([rows[:25], rows[25:]]), state)
        want = {i: str(int(alone.setdefault(c, PixelMixture(8, params)).apply(d).sum())) for i, (c, d) in enumerate(zip(clients, data, strict=True))}
        assert dict(zip(found["event_id"], found["foreground"], strict=True)) == want
    assert kd._unpacked(state.get[0]) == {c: m.pack() for c, m in alone.items()}


def test_throttle_lane():
    random, state, step = np.random.default_rng(2), State(), kd.Throttle(20.0, 2)
    alone = {c: (State(), kd.Throttle(20.0, 2)) for c in ("a", "b", None)}
    for batch in range(3):
        clients = random.choice(np.array(["a", "b", None], object), 30).tolist()
        rows = _rows(clients, batch * 300 + np.sort(random.integers(0, 300, 30)))
        (found,) = step(("0",), iter([rows]), state)
        for name, (own, single) in alone.items():
            mine = rows[[c == name for c in clients]]
            (want,) = single(("0",), iter([mine]), own)
            got = found[found["event_id"].isin(mine["event_id"])].sort_values("event_id", ignore_index=True)
            pd.testing.assert_frame_equal(got, want.sort_values("event_id", ignore_index=True))
    assert list(found.columns) == ["ts", "event_id", "n", "emit_ts"]
    # the bucket by hand: burst of two, then one each 20 seconds
    (found,) = kd.Throttle(20.0, 2)(("0",), iter([_rows(["x", "y"] * 4, [0, 0, 1, 50, 2, 51, 3, 52])]), State())
    emitted = found.assign(s=(found["emit_ts"] - START).dt.total_seconds()).sort_values(["event_id"])["s"].tolist()
    assert emitted == [0, 0, 1, 50, 20, 51, 40, 70]


def test_grouped_lane():
    day = 86_400 * 1_000_000
    step, state = kd.GroupedWithin("device", 2, day), State()
    clients = ["a", None, "a", "b", "a", None, "b"]
    rows = _rows(clients, [0, 1, 2, 3, 4, 86_400, 86_401], payload=list("0123456"))
    (found,) = step(("0",), iter([rows]), state)
    assert found[["device", "batch", "frames"]].values.tolist() == [["a", "0", "[0,2]"]]
    first = int(START.value // 1000) + day
    assert state.timer == first // 1000 - 1
    state.watermark = first // 1000
    (found,) = step(("0",), iter([_rows(["b"], [86_402], payload=["7"])]), state)
    got = {(r.device, r.window_start, r.batch, r.frames) for r in found.itertuples()}
    later = START + pd.Timedelta(days=1)
    assert got == {("b", later, "0", "[6,7]"), ("a", START, "1", "[4]"), (None, START, "0", "[1]"), ("b", START, "0", "[3]")}
    state.hasTimedOut, state.watermark = True, (first + day) // 1000
    (found,) = step(("0",), iter([]), state)
    assert found.values.tolist() == [[None, later, "0", "[5]"]] and not state.exists

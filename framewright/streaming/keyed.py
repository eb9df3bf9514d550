"""Stateful streaming operators on Spark's keyed state.

Each operator is a function of one key's new rows and its state, which Spark keeps in its RocksDB store: a
micro-batch touches the state of the keys it holds and no other. Operators whose clients are many and have little to do
are called for a lane of clients at once, see ``in_lanes``. Rows of a client are taken in the order they
arrive, inside a micro-batch by (ts, event_id). Without a timer nothing is late and nothing is dropped; operators with
one follow the watermark, and rows that it has passed are dropped and counted. A key's rows
of one micro-batch are in one task: ``max_files`` of the source bounds them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.operators.background import MixtureParams, subtract_runs
from framewright.operators.batching import walk
from framewright.session import ship_package, work_path
from framewright.streaming.runner import replay_to_table

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Lanes that clients are dealt to.
LANES = 1024

Step = Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]


def _whole_numbers_as_text(df: DataFrame, spare: Sequence[str] = ("event_id",)) -> DataFrame:
    """Integer columns as text: pandas would turn those with nulls into floating point."""
    return df.withColumns(
        {
            f.name: F.col(f.name).cast("string")
            for f in df.schema
            if isinstance(f.dataType, T.IntegralType) and f.name not in spare
        }
    )


def keyed(stream: DataFrame, keys: Sequence[str], step: Step, out: T.StructType, state: str, watermark: bool = False) -> DataFrame:
    """A stream through ``step``, in the types of ``out``. With ``watermark`` a key may set an event-time timer."""
    spark = _prepared(stream)
    guarded = _whole_numbers_as_text(spark.createDataFrame([], out)).schema
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    rows = _whole_numbers_as_text(stream).groupBy(*keys).applyInPandasWithState(step, guarded, state, "append", timeout)
    return _typed(rows, out)


def processed(stream: DataFrame, keys: Sequence[str], processor: StatefulProcessor, out: T.StructType) -> DataFrame:
    """A stream with a watermark through a processor with states and timers of its own, in the types of ``out``."""
    spark = _prepared(stream)
    guarded = _whole_numbers_as_text(spark.createDataFrame([], out)).schema
    rows = _whole_numbers_as_text(stream).groupBy(*keys).transformWithStateInPandas(processor, guarded, "append", "EventTime")
    return _typed(rows, out)


def _prepared(stream: DataFrame):
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    # a micro-batch uploads what changed, not a whole snapshot
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def _typed(rows: DataFrame, out: T.StructType) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in out])


def run_keyed(
    stream: DataFrame, keys: Sequence[str], step: Step, out: T.StructType, state: str, path: str, watermark: bool = False
) -> DataFrame:
    """Replay a stream through ``step`` and return the rows of all micro-batches."""
    return replay_to_table(keyed(stream, keys, step, out, state, watermark), path).select(*out.names)


def in_lanes(stream: DataFrame, client: Column) -> DataFrame:
    """The stream with the ``_lane`` of each client and its name, ``_client``, as text.

    A call of a step costs a millisecond or more whatever it does, a state's read and write besides. By lane a micro-batch makes
    at most ``LANES`` calls instead of one for each client. A lane's state is that of its clients, the ``LANES``-th part of all.
    """
    name = client.cast("string")
    return stream.withColumns({"_client": name, "_lane": F.pmod(F.xxhash64(name), F.lit(LANES)).cast("int")})


def _named(rows: pd.DataFrame, name: str, key: tuple) -> pd.Series:
    """A column that names the rows' client; the key does where the rows don't."""
    return rows[name] if name in rows else pd.Series(key[0], rows.index)


def _by_client(rows: pd.DataFrame, key: tuple) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """The clients of some rows, an order that puts each one's rows together as they were, and where they begin in it."""
    code, names = pd.factorize(_named(rows, "_client", key), use_na_sentinel=False)
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(len(names) + 1))
    return [None if pd.isna(n) else n for n in names], order, edges


def timeout_ms(state: GroupState, us: int) -> None:
    """Let the key be called once the watermark has reached a time in microseconds."""
    state.setTimeoutTimestamp(max(-(-us // 1000) - 1, state.getCurrentWatermarkMs()))


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _in_order(pieces: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pieces), ignore_index=True).sort_values(["ts", "event_id"], kind="stable", ignore_index=True)


def _us(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def _times(us: np.ndarray) -> np.ndarray:
    return us.astype("datetime64[us]").astype("datetime64[ns]")


class Throttle:
    """State of a lane, as JSON: each client, its frames so far and the running maximum of ts - n * d."""

    state = "seen string"

    def __init__(self, period_seconds: float, burst: int):
        self.d = round(period_seconds * 1e9)
        self.burst = burst

    def __call__(self, key, pieces, state):
        rows = _in_order(pieces)
        seen = {name: (n, peak) for name, n, peak in json.loads(state.get[0])} if state.exists else {}
        names, order, edges = _by_client(rows, key)
        rows = rows.take(order)
        first, size = edges[:-1], np.diff(edges)
        before = np.array([seen.get(name, (0, None))[0] for name in names], np.int64)
        ns = _us(rows["ts"]) * 1000
        n = np.arange(len(rows)) + np.repeat(before - first, size)
        lead = ns - n * self.d
        for name, i in zip(names, first.tolist(), strict=True):
            if name in seen:
                lead[i] = max(lead[i], seen[name][1])
        top = pd.Series(lead).groupby(np.repeat(np.arange(len(names)), size)).cummax().to_numpy()
        emit = np.maximum(ns, (n + 1 - self.burst) * self.d + top) // 1000
        last = edges[1:] - 1
        seen.update(zip(names, zip((n[last] + 1).tolist(), top[last].tolist(), strict=True), strict=True))
        state.update((json.dumps([[name, *held] for name, held in seen.items()]),))
        yield rows.drop(columns=["_client", "_lane"], errors="ignore").assign(n=[str(x) for x in n], emit_ts=_times(emit))


class GroupedWithin:
    """State of a lane, as JSON: the clients' open windows, each with the number of its next batch and its waiting frames, fewer
    than a batch. The lane's timer is the end of the first open window; it flushes the frames that wait."""

    state = "open string"

    def __init__(self, key: str, size: int, width: int):
        self.key, self.size, self.width = key, size, width

    def __call__(self, key, pieces, state):
        held = {(name, window): entry for name, window, *entry in json.loads(state.get[0])} if state.exists else {}
        out = []
        if not state.hasTimedOut:
            rows = _in_order(pieces)
            code, names = pd.factorize(_named(rows, "_client", key), use_na_sentinel=False)
            names = [None if pd.isna(n) else n for n in names]
            start = _us(rows["ts"]) // self.width * self.width
            order = np.lexsort((start, code))
            code, start, payloads = code[order], start[order], rows["payload"].to_numpy(object)[order].tolist()
            edges = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (start[1:] != start[:-1]), True]).tolist()
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                client, window = names[code[i]], int(start[i])
                entry = held.setdefault((client, window), [0, []])
                number, waiting = entry[0], entry[1] + payloads[i:j]
                whole = len(waiting) // self.size * self.size
                for k in range(0, whole, self.size):
                    out.append((client, window, number + k // self.size, waiting[k : k + self.size]))
                entry[0], entry[1] = number + whole // self.size, waiting[whole:]
        now = state.getCurrentWatermarkMs() * 1000
        for client, window in [k for k in held if k[1] + self.width <= now]:
            number, frames = held.pop((client, window))
            if frames:
                out.append((client, window, number, frames))
        if held:
            state.update((json.dumps([[*k, *entry] for k, entry in held.items()]),))
            timeout_ms(state, min(w for _, w in held) + self.width)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(
                {
                    self.key: [c for c, _, _, _ in out],
                    "window_start": _times(np.array([w for _, w, _, _ in out], np.int64)),
                    "batch": [str(b) for _, _, b, _ in out],
                    "frames": ["[" + ",".join(f) + "]" for _, _, _, f in out],
                }
            )


class TimedBatches:
    """State: frames held, when the timer fires next, and the open batch's number."""

    state = "held bigint, deadline bigint, open_batch bigint"

    def __init__(self, size: int, seconds: float):
        self.size = size
        self.interval = round(seconds * 1e6)

    def __call__(self, key, pieces, state):
        rows = _in_order(pieces)
        held, deadline, number = state.get if state.exists else (0, None, 0)
        batch, held, deadline, closed = walk(_us(rows["ts"]), self.size, self.interval, held, deadline)
        state.update((held, deadline, number + closed))
        yield rows.assign(device=_named(rows, "device", key))[["device", "ts", "event_id"]].assign(batch=(number + batch).astype(str))


class ChunkStreams:
    """State: whether a stream is open, its id, opener, rows and total. Gives the streams that ended."""

    state = "open int, stream bigint, opened_by string, n_rows bigint, total bigint"

    def __call__(self, key, pieces, state):
        rows = _in_order(pieces)
        open_, stream, opener, n_rows, total = state.get if state.exists else (0, 0, None, 0, 0)
        role = rows["role"].to_numpy(object)
        units = rows["units"].fillna("0").astype(np.int64).to_numpy()
        openers = np.cumsum(role == "O")
        forced = np.maximum.accumulate(np.where(role != "O", np.arange(len(role)), -1))
        base = np.where(forced >= 0, role[forced] == "C", bool(open_)).astype(int)
        after = (base + openers - np.where(forced >= 0, openers[forced], 0)) % 2
        before = np.r_[open_, after[:-1]]
        started = (before == 0) & (after == 1)
        ids = stream + np.cumsum(started)
        inside = np.flatnonzero((before == 1) | (after == 1))
        first, last = int(stream), int(ids[-1])
        rows_of, total_of = np.zeros(last - first + 1, np.int64), np.zeros(last - first + 1, np.int64)
        np.add.at(rows_of, ids[inside] - first, 1)
        np.add.at(total_of, ids[inside] - first, units[inside] * after[inside])
        rows_of[0] += n_rows
        total_of[0] += total
        opened = [opener, *role[started].tolist()]
        end = np.flatnonzero((before == 1) & (after == 0))
        at = ids[end] - first
        if after[-1]:
            state.update((1, last, opened[-1], int(rows_of[-1]), int(total_of[-1])))
        else:
            state.update((0, last, None, 0, 0))
        yield pd.DataFrame(
            {
                "conn": [key[0]] * len(end),
                "stream": ids[end].astype(str),
                "opened_by": [opened[i] for i in at],
                "n_rows": rows_of[at].astype(str),
                "total": total_of[at].astype(str),
                "status": np.where(role[end] == "T", "completed", "aborted"),
                "ts": rows["ts"].to_numpy()[end],
                "event_id": rows["event_id"].to_numpy()[end],
            }
        )


class RequestReply(StatefulProcessor):
    """State per connection: how many commands and replies came, and those of the side that is ahead by their number.

    A micro-batch writes what begins or ends to wait in it, and no more. Only what comes in different micro-batches is
    stored at all. A connection without rows for ``close_after`` of event time closes: its unanswered commands
    fail, and replies without a command go.
    """

    def __init__(self, close_after_ms: int):
        self.close_after = close_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "n_cmd bigint, n_reply bigint, closes bigint")
        self.waiting = handle.getMapState("waiting", "seq bigint", "id bigint, us bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        rows = _in_order(rows)
        n_cmd, n_reply, closes = map(int, self.counts.get()) if self.counts.exists() else (0, 0, 0)
        first = {"cmd": n_cmd, "reply": n_reply}
        new, us = {}, _us(rows["ts"])
        for side in first:
            own = (rows["side"] == side).to_numpy()
            new[side] = list(zip(rows["event_id"][own].tolist(), us[own].tolist(), strict=True))
        end = {side: first[side] + len(new[side]) for side in first}

        def take(side: str, seq: int):
            if seq >= first[side]:
                return new[side][seq - first[side]]
            found = self.waiting.getValue((seq,))
            self.waiting.removeKey((seq,))
            return tuple(map(int, found))

        done = range(min(first.values()), min(end.values()))
        pairs = [(seq, *take("cmd", seq), *take("reply", seq)) for seq in done]
        for side in first:
            for seq in range(max(first[side], done.stop), end[side]):
                self.waiting.updateValue((seq,), new[side][seq - first[side]])
        later = max(closes, (int(us.max()) if len(us) else 0) // 1000 + self.close_after)
        self.counts.update((end["cmd"], end["reply"], later))
        if later != closes:
            if closes:
                self.handle.deleteTimer(closes)
            self.handle.registerTimer(later)
        if pairs:
            yield self.frame(key, pairs, "answered", None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        n_cmd, n_reply, _ = map(int, self.counts.get())
        left = [(seq, *map(int, self.waiting.getValue((seq,)))) for seq in range(n_reply, n_cmd)]
        self.waiting.clear()
        last = max(n_cmd, n_reply)
        self.counts.update((last, last, 0))
        if left:
            yield self.frame(key, [(*x, None, None) for x in left], "failed", "ConnectionClosed")

    def frame(self, key, rows, status, reason):
        seq, cmd, cmd_us, reply, reply_us = zip(*rows, strict=True)
        return pd.DataFrame(
            {
                "conn": [key[0]] * len(seq),
                "seq": [str(s) for s in seq],
                "cmd_id": [str(c) for c in cmd],
                "cmd_ts": _times(np.array(cmd_us, np.int64)),
                "reply_id": [None if r is None else str(r) for r in reply],
                "reply_ts": pd.Series([None if t is None else pd.Timestamp(t, unit="us") for t in reply_us], dtype="datetime64[ns]"),
                "status": status,
                "reason": pd.Series([reason] * len(seq), dtype=object),
            }
        )

    def close(self) -> None:
        pass


class FailureBreaker:
    """State per host and period: failures so far. It goes when the watermark passes the period."""

    state = "failures bigint"

    def __init__(self, max_failures: int):
        self.max = max_failures

    def __call__(self, key, pieces, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(pieces)
        before = state.get[0] if state.exists else 0
        count = before + 1 + np.arange(len(rows))
        state.update((int(count[-1]),))
        end = int(rows["end_ms"].iloc[0])
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        hit = np.flatnonzero(count % self.max == 0)
        yield pd.DataFrame(
            {
                "host": [key[0]] * len(hit),
                "window_start": rows["start"].to_numpy()[hit],
                "down_ts": rows["at"].to_numpy()[hit],
                "nth": (count[hit] // self.max).astype(str),
            }
        )


class Background:
    """State of a lane: the mixtures of its tiles."""

    state = "models binary"

    def __init__(self, params: MixtureParams):
        self.params = params

    def __call__(self, key, pieces, state):
        rows = _in_order(pieces)
        names, order, edges = _by_client(rows, [str(k) for k in key])
        rows = rows.take(order)
        data = rows["data"].tolist()
        if any(d is None for d in data):
            raise TypeError("a frame without pixels")
        models = _unpacked(state.get[0]) if state.exists else {}
        known = [models.get(name) for name in names]
        length = np.fromiter(map(len, data), np.int64, len(data))
        for name, model, size in zip(names, known, length[edges[:-1]].tolist(), strict=True):
            if model is not None and len(model) != 24 * self.params.components * size:
                raise ValueError(f"a frame of {size} pixels of tile {name}, whose model has another size")
        start = np.cumsum(length) - length
        masks, after = subtract_runs(np.frombuffer(b"".join(data), np.uint8), start, length, edges, known, self.params)
        models.update(zip(names, after, strict=True))
        state.update((_packed(models),))
        total = np.r_[0, np.cumsum(masks, dtype=np.int64)]
        yield pd.DataFrame(
            {
                "device": _named(rows, "device", key).to_numpy(),
                "ts": rows["ts"].to_numpy(),
                "event_id": rows["event_id"].to_numpy(),
                "foreground": (total[start + length] - total[start]).astype(str),
            }
        )


def _packed(models: dict[str, bytes]) -> bytes:
    batch = pa.record_batch([pa.array(models.keys(), pa.string()), pa.array(models.values(), pa.binary())], ["key", "model"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> dict[str, bytes]:
    table = pa.ipc.open_stream(pa.py_buffer(bytes(packed))).read_all()
    return dict(zip(table["key"].to_pylist(), table["model"].to_pylist(), strict=True))


def fresh(spark, path: str | None, name: str) -> str:
    return path or work_path(spark, name)

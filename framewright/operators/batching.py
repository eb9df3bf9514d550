"""Batches closed by size or by a timer that starts anew with every full batch.

When the timer fires next depends on all earlier full batches, so a client's frames are walked in order: sorted
partitions, read as a stream, three numbers of state per client. The walk takes runs of full batches, and runs of
windows that the timer closes, as whole arrays.

A hot client is cut into chunks of its order. What a chunk does is a transition from the state it is entered with, (frames
held, next firing), to the one it is left with and the number of batches it closes. Transitions are measured in all
chunks at once, from several states that are likely: a batch that became full at one of the last frames before the
chunk, or none since the client's first frame. The chain from the first chunk then either finds every state measured, or
the state it lacks is measured next, along with those the chunks behind may be entered with. So rows are always those
of the walk; guesses only spare rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import micros
from framewright.operators.handlers import handler_process_stream
from framewright.operators.ordering import KeyedScan

#: Frames held and when the timer fires next; None before the first frame.
State = tuple[int, int | None]

#: States a chunk is measured from in one round, at most, besides the one it is known to be entered with.
GUESSES = 16
_LONGEST = 1 << 16


def walk(us: np.ndarray, size: int, interval: int, held: int, deadline: int | None) -> tuple[np.ndarray, int, int | None, int]:
    """The batch of each frame, counted from the one open at the start; the state after them; how many batches closed."""
    n, at, number, span = len(us), 0, 0, 8
    batch = np.empty(n, np.int64)
    if n and deadline is None:
        deadline = int(us[0]) + interval
    while at < n:
        now = int(us[at])
        if now >= deadline:
            number += held > 0
            held = 0
            deadline += ((now - deadline) // interval + 1) * interval
        if held == 0:
            k = 0
            if n - at >= size:  # full batches, one behind the other
                ends = us[at + size - 1 : at + min((n - at) // size, span) * size : size]
                late = np.flatnonzero(np.diff(ends, prepend=deadline - interval) >= interval)
                k = int(late[0]) if len(late) else len(ends)
                taken = k * size
            if k:
                batch[at : at + taken] = number + np.repeat(np.arange(k), size)
                deadline = int(ends[k - 1]) + interval
                whole = k == len(ends)
            else:  # windows that the timer closes, up to one that may become full
                window = (us[at : at + span * size] - (deadline - interval)) // interval
                first = np.flatnonzero(np.diff(window, prepend=-1))
                counts = np.diff(first, append=len(window))
                full = np.flatnonzero(counts >= size)
                k = int(full[0]) if len(full) else len(first) - 1
                taken = int(first[k])
                batch[at : at + taken] = number + np.repeat(np.arange(k), counts[:k])
                deadline += int(window[taken]) * interval
                whole = not len(full)
            if k:
                number, at = number + k, at + taken
                span = min(2 * span, _LONGEST) if whole else 8
                continue
        end = at + int(np.searchsorted(us[at : at + size - held], deadline))
        batch[at:end] = number
        held += end - at
        at = end
        if held == size:
            held, number, deadline = 0, number + 1, int(us[at - 1]) + interval
    return batch, held, deadline, number


class WalkBatches:
    """Numbers the batch of each frame of a client, or of one of its chunks from the state it is entered with."""

    def __init__(self, size: int, interval: int, entries=None):
        self.size = size
        self.interval = interval
        self.entries = entries

    def __call__(self, key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, deadline, number = (0, None, 0) if self.entries is None else self.entries.value[key]
        for piece in pieces:
            us = piece["us"].to_numpy(np.int64)
            batch, held, deadline, closed = walk(us, self.size, self.interval, held, deadline)
            yield pd.DataFrame({"device": key[0], "ts": piece["ts"], "event_id": piece["event_id"], "batch": number + batch})
            number += closed


class _ChunkEnds:
    """The time of a chunk's first frame and of its last ``size`` frames."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last = None, np.zeros(0, np.int64)
        for piece in pieces:
            us = piece["us"].to_numpy(np.int64)
            first = int(us[0]) if first is None else first
            last = np.concatenate([last, us])[-self.size :]
        yield pd.DataFrame({"device": [key[0]], "chunk": [key[1]], "first": [first], "last": [last.tolist()]})


class _Measure:
    """What a chunk makes of each state it is asked for. States that have become equal are walked once."""

    def __init__(self, size: int, interval: int, asked):
        self.size = size
        self.interval = interval
        self.asked = asked

    def __call__(self, key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = {state: (state, 0) for state in self.asked.value.get(key, ())}
        for piece in pieces:
            us, done = piece["us"].to_numpy(np.int64), {}
            for entry, (state, closed) in now.items():
                if state not in done:
                    done[state] = walk(us, self.size, self.interval, *state)[1:]
                held, deadline, more = done[state]
                now[entry] = (held, deadline), closed + more
        if now:
            rows = [(key[0], key[1], *entry, *state, closed) for entry, (state, closed) in now.items()]
            out = pd.DataFrame(rows, columns=["device", "chunk", "held", "deadline", "end_held", "end_deadline", "closed"])
            yield out.assign(deadline=out["deadline"].astype("Int64"), end_deadline=out["end_deadline"].astype("Int64"))


def _guesses(last: list[int], first: int, size: int, interval: int) -> list[State]:
    """Likely states after frames of which ``last`` are the last; ``first`` is the client's first one."""
    before = np.array(last, np.int64)
    opened = (int(before[-1]) - first) // interval * interval + first  # the timer never started again
    found = [(min(int(np.count_nonzero(before >= opened)), size - 1), opened + interval)]
    for i in range(len(last) - 1, max(-1, len(last) - 1 - min(size, GUESSES)), -1):
        found.append(walk(before[i + 1 :], size, interval, 0, last[i] + interval)[1:3])
    return found


def _entries(hot: DataFrame, size: int, interval: int) -> dict[tuple, tuple[int, int | None, int]]:
    """The proven state and batch number each (client, chunk) is entered with.

    The driver holds up to ``GUESSES`` small rows per chunk, and there are as many chunks as hot rows fill.
    """
    spark = hot.sparkSession
    kind = hot.schema["device"].dataType.simpleString()
    keys, order = ["device", "chunk"], ["ts", "event_id"]
    ends = handler_process_stream(hot, keys, order, _ChunkEnds(size), f"device {kind}, chunk int, first bigint, last array<bigint>")
    chunks: dict = {}
    for row in ends.collect():
        chunks.setdefault(row["device"], []).append((row["chunk"], row["first"], list(row["last"])))
    asked: dict[tuple, set[State]] = {}
    for device, own in chunks.items():
        own.sort()
        asked[device, own[0][0]] = {(0, None)}
        for (_, _, last), (chunk, _, _) in zip(own[:-1], own[1:], strict=True):
            asked[device, chunk] = set(_guesses(last, own[0][1], size, interval))
    known: dict[tuple, dict[State, tuple[State, int]]] = {key: {} for key in asked}
    schema = f"device {kind}, chunk int, held bigint, deadline bigint, end_held bigint, end_deadline bigint, closed bigint"
    while True:
        wanted = spark.createDataFrame([(d, c) for d, c in asked], f"d {kind}, c int")
        some = hot.join(wanted, F.col("device").eqNullSafe(F.col("d")) & (F.col("chunk") == F.col("c")), "left_semi")
        measure = _Measure(size, interval, spark.sparkContext.broadcast(asked))
        for r in handler_process_stream(some, keys, order, measure, schema).collect():
            known[r["device"], r["chunk"]][r["held"], r["deadline"]] = (r["end_held"], r["end_deadline"]), r["closed"]
        asked, entries = {}, {}
        for device, own in chunks.items():
            state, number = (0, None), 0
            for place, (chunk, _, _) in enumerate(own):
                entries[device, chunk] = (*state, number)
                if state not in known[device, chunk]:
                    asked[device, chunk] = {state}
                    for here, (behind, _, _) in zip(own[place:], own[place + 1 :], strict=False):
                        likely = {end for end, _ in known[device, here[0]].values()} - known[device, behind].keys()
                        if likely:
                            asked[device, behind] = set(sorted(likely)[:GUESSES])
                    break
                state, closed = known[device, chunk][state]
                number += closed
        if not asked:
            return entries


def timed_batches(frames: DataFrame, size: int, seconds: float, hot_rows: int | None = None) -> DataFrame:
    """Batch number of every frame: ``device``, ``ts``, ``event_id``, ``batch``."""
    interval, keys, order = round(seconds * 1e6), ["device"], ["ts", "event_id"]
    log = frames.select("device", *order).withColumn("us", micros(F.col("ts")))
    schema = f"device {frames.schema['device'].dataType.simpleString()}, ts timestamp_ntz, event_id bigint, batch bigint"
    scan = KeyedScan(log, keys, order, hot_rows)
    cold = scan.rows.where("_chunk = 0").drop("_chunk") if scan.split else scan.rows
    whole = handler_process_stream(cold, keys, order, WalkBatches(size, interval), schema)
    if not scan.split:
        return whole
    hot = scan.rows.where("_chunk > 0").withColumnRenamed("_chunk", "chunk")
    entries = log.sparkSession.sparkContext.broadcast(_entries(hot, size, interval))
    parts = handler_process_stream(hot, ["device", "chunk"], order, WalkBatches(size, interval, entries), schema)
    return whole.unionByName(parts)


def grouped_within_timer(frames: DataFrame, size: int = 5, seconds: float = 1.0, hot_rows: int | None = None) -> DataFrame:
    """Batches of at most ``size`` frames per client. The timer first runs from a client's first
    frame, fires every ``seconds`` and is started again by each full batch."""
    return collect_batches(timed_batches(frames, size, seconds, hot_rows))


def collect_batches(numbered: DataFrame) -> DataFrame:
    """One row per batch, its frames in order (at most the batch size each)."""
    frames = F.sort_array(F.collect_list(F.struct("ts", "event_id")))
    return (
        numbered.groupBy("device", "batch").agg(frames.alias("frames")).withColumn("n", F.size("frames").cast("bigint"))
    )

"""Batches with a timer that starts anew: the vectorised walk, and hot clients cut into chunks."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from framewright.operators import batching

DAY = dt.datetime(2024, 1, 1)


def plain(times, size, interval, held=0, deadline=None, number=0):
    """One frame after the other."""
    out = []
    for now in times:
        if deadline is None:
            deadline = now + interval
        while now >= deadline:
            number += held > 0
            held = 0
            deadline += interval
        out.append(number)
        held += 1
        if held == size:
            held, number, deadline = 0, number + 1, now + interval
    return out, held, deadline, number


def rising(rng, n, steps):
    at, out = rng.randrange(-50, 50), []
    for _ in range(n):
        at += rng.choice(steps)
        out.append(at)
    return out


REGIMES = {"dense": [0, 1, 1, 2], "sparse": [7, 13, 29], "mixed": [0, 0, 1, 3, 9, 25], "bursts": [0] * 12 + [40], "even": [5]}


@pytest.mark.parametrize("regime", sorted(REGIMES))
@pytest.mark.parametrize("size", [1, 2, 3, 5, 16])
def test_walk_equals_single_steps(regime, size):
    rng = random.Random(f"{regime}{size}")
    for _ in range(150):
        times, interval = rising(rng, rng.randint(0, 200), REGIMES[regime]), rng.choice([1, 4, 10, 30])
        state, number, found = (0, None), 0, []
        cuts = sorted(rng.randint(0, len(times)) for _ in range(rng.randint(0, 4)))
        for a, b in zip([0, *cuts], [*cuts, len(times)], strict=True):
            batch, *state, closed = batching.walk(np.array(times[a:b], np.int64), size, interval, *state)
            found += (batch + number).tolist()
            number += closed
        assert (found, *state, number) == plain(times, size, interval)


def frames_of(spark, times):
    rows = [(k, DAY + dt.timedelta(milliseconds=t), i) for k, own in times.items() for i, t in enumerate(own)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "device int, ts timestamp_ntz, event_id bigint").repartition(3)


@pytest.mark.parametrize("hot", [1, 17, 10_000])
def test_chunks_of_a_hot_client_give_the_batches_of_the_walk(spark, hot, monkeypatch):
    """All regimes, one after the other too, so that guesses hold in some chunks and fail in others."""
    rng = random.Random(hot)
    keys = dict(zip([0, 1, 2, 3, None], REGIMES.values(), strict=True))
    times = {k: rising(rng, 40 if hot == 1 else 120, steps) for k, steps in keys.items()}
    times[9] = rising(rng, 60, REGIMES["dense"])
    for steps in ("sparse", "even", "dense", "bursts"):
        times[9] += [times[9][-1] + 50 + t for t in rising(rng, 60, REGIMES[steps])]
        times[9].sort()
    found = batching.timed_batches(frames_of(spark, times), 3, 0.01, hot_rows=hot)
    got = {}
    for r in found.collect():
        got.setdefault(r.device, {})[r.event_id] = r.batch
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: plain(t, 3, 10)[0] for k, t in times.items()}


def test_guesses_settle_even_and_empty_windows_in_one_round(spark, monkeypatch):
    rounds = []
    real = batching._Measure
    monkeypatch.setattr(batching, "_Measure", lambda *a: rounds.append(1) or real(*a))
    times = {1: list(range(0, 600, 2)), 2: list(range(0, 6000, 20))}
    batching.timed_batches(frames_of(spark, times), 5, 0.05, hot_rows=30).count()
    assert len(rounds) == 1

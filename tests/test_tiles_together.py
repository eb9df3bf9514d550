"""The background model works on many tiles at once."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa

from framewright.operators import background as bg


def _rows(frames: dict, seeds: dict) -> pa.RecordBatch:
    rows = []
    for (device, tile), data in frames.items():
        if (device, tile) in seeds:
            rows.append((device, tile, dt.datetime(2024, 1, 1), -1, None, seeds[device, tile]))
        rows += [(device, tile, dt.datetime(2024, 1, 2) + dt.timedelta(seconds=i), i, d.tobytes(), None) for i, d in enumerate(data)]
    kinds = [pa.string(), pa.int32(), pa.timestamp("us"), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list("abcdef"))


def test_tiles_share_steps(monkeypatch):
    random, params = np.random.default_rng(3), bg.MixtureParams()
    frames, seeds = {}, {}
    for i in range(60):
        for tile, pixels in ((0, 8), (1, 3)):
            name = (None if i == 0 else f"d{i:03d}", tile)
            frames[name] = random.choice(np.array([10, 12, 90, 200], np.uint8), (1 + i % 20, pixels))
            if i % 7 == 3:
                known = bg.PixelMixture(pixels, params)
                known.apply(random.integers(0, 255, pixels).astype(np.uint8))
                seeds[name] = known.pack()
    masks, models = {}, {}
    for name, data in frames.items():
        alone = bg.PixelMixture(data.shape[1], params, seeds.get(name))
        masks |= {(*name, i): alone.apply(d).tobytes() for i, d in enumerate(data)}
        models[name] = alone.pack()
    steps, step = [], bg.PixelMixture.apply_first
    monkeypatch.setattr(bg.PixelMixture, "apply_first", lambda self, pixels: steps.append(len(pixels)) or step(self, pixels))
    whole = _rows(frames, seeds)
    for size in (10_000, 37):  # in one block, and in blocks that cut tiles
        monkeypatch.setattr(bg, "BLOCK_ROWS", size)
        steps.clear()
        pieces = [whole.slice(i, 37) for i in range(0, whole.num_rows, 37)]
        found = [r for b in bg._SubtractTiles(params)(iter(pieces)) for r in b.to_pylist()]
        if size > whole.num_rows:
            assert len(steps) == 2 * 20  # as many as the longest tile of either size has frames, not one a row
        assert {(r["device"], r["tile"], r["event_id"]): r["mask"] for r in found if r["mask"] is not None} == masks
        assert all(sum(r["mask"]) == r["foreground"] for r in found if r["mask"] is not None)
        ends = [r for r in found if r["model"] is not None]
        assert {(r["device"], r["tile"]): r["model"] for r in ends} == models and len(ends) == len(models)
        assert all(r["event_id"] == len(frames[r["device"], r["tile"]]) - 1 for r in ends)

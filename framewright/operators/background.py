"""Adaptive per-pixel Gaussian mixture background model (Zivkovic, ICPR 2004) over keyed frames.

The model of a pixel depends on all its earlier frames, so time cannot be split; pixels can. A
frame is cut into tiles, (device, tile) is the shuffle key, and rows reach Python sorted by time
within a partition and are read as a stream. A task holds one block of rows and the models of the tiles
in it, however many frames a tile has. The tiles of a block are worked on together, frame by frame, since a
step of a small tile is little arithmetic and much overhead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.arrays import places
from framewright.operators.ordering import sorted_by_key

#: Pixels whose mixtures take a step together, of several tiles if need be. It changes no result.
STEP_PIXELS = 4096
#: A task works on so many rows at once, or on fewer with so many bytes of pixels. It bounds memory and changes no result.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 1 << 20


@dataclass(frozen=True)
class MixtureParams:
    """The first three as the motion detector is configured, the rest as published."""

    history: int = 200
    threshold: float = 20.0  # squared distance, in variances, up to which a pixel is background
    learning_rate: float = 0.1
    components: int = 5
    background_ratio: float = 0.9
    generation_threshold: float = 9.0
    initial_variance: float = 15.0
    min_variance: float = 4.0
    max_variance: float = 75.0
    complexity: float = 0.05

    def rate(self) -> float:
        return self.learning_rate if self.learning_rate >= 0 else 1.0 / self.history


class PixelMixture:
    """The mixtures of a tile: weights, means and variances, each (components, pixels).

    Components are kept heaviest first; one with weight 0 is unused.
    """

    def __init__(self, pixels: int, params: MixtureParams, packed: bytes | None = None):
        self.params = params
        shape = (3, params.components, pixels)
        self.model = np.zeros(shape) if packed is None else np.frombuffer(packed, dtype=np.float64).reshape(shape).copy()

    def pack(self) -> bytes:
        return self.model.tobytes()

    def apply(self, pixels: np.ndarray) -> np.ndarray:
        """Classify a frame (1 = foreground) and learn from it."""
        if len(pixels) != self.model.shape[2]:
            raise ValueError(f"a frame of {len(pixels)} pixels for a model of {self.model.shape[2]}")
        return self.apply_first(pixels)

    def apply_first(self, pixels: np.ndarray) -> np.ndarray:
        """As ``apply``, for the first pixels of the model only."""
        p, alpha = self.params, self.params.rate()
        weight, mean, var = self.model[:, :, : len(pixels)]
        x = pixels.astype(np.float64)
        active = weight > 0
        off = x - mean
        dist = off * off
        heavier = weight.cumsum(axis=0) - weight
        behind = active & (heavier < p.background_ratio) & (dist < p.threshold * var)
        close = active & (dist < p.generation_threshold * var)
        matched = close.any(axis=0)

        # every component decays; the heaviest close one owns the sample and moves toward it
        weight *= 1 - alpha
        weight -= alpha * p.complexity * active
        owned = matched.nonzero()[0]
        if len(owned):
            own = (close.argmax(axis=0)[owned], owned)
            weight[own] += alpha
            step = np.minimum(alpha / weight[own], 1.0)
            mean[own] += step * off[own]
            moved = var[own]
            moved += step * (dist[own] - moved)
            var[own] = np.minimum(np.maximum(moved, p.min_variance), p.max_variance)
        np.maximum(weight, 0.0, out=weight)

        if len(owned) < len(x):
            new = (~matched).nonzero()[0]
            slot = (weight[:, new].argmin(axis=0), new)
            weight[slot], mean[slot], var[slot] = alpha, x[new], p.initial_variance

        weight /= weight.sum(axis=0)
        unsorted = (weight[1:] > weight[:-1]).any(axis=0).nonzero()[0]
        if len(unsorted):
            part = self.model[:, :, unsorted]
            order = np.argsort(-part[0], axis=0, kind="stable")
            self.model[:, :, unsorted] = part[:, order, np.arange(len(unsorted))]
        return (~behind.any(axis=0)).astype(np.uint8)


def tiles(frames: DataFrame, frame_pixels: int, tile_pixels: int) -> DataFrame:
    """One row per frame and tile; ``data`` holds the tile's bytes."""
    n = -(-frame_pixels // tile_pixels)
    return frames.withColumn("tile", F.explode(places(n))).withColumn(
        "data", F.substring(F.col("data"), F.col("tile") * tile_pixels + 1, F.lit(tile_pixels))
    )


def subtract_runs(
    data: np.ndarray, start: np.ndarray, length: np.ndarray, edges: np.ndarray, models: list[bytes | None], params: MixtureParams
) -> tuple[np.ndarray, list[bytes]]:
    """Masks of the frames of some tiles, laid out as their ``data``, and the tiles' models after them.

    Row i is ``data[start[i] : start[i] + length[i]]``; tile k has the rows from ``edges[k]`` to ``edges[k + 1]`` in the order
    of time, at least one, and begins with ``models[k]``. Each step takes the next frame of many tiles of one size.
    """
    masks, after = np.zeros(len(data), np.uint8), list(models)
    n, size = np.diff(edges), length[edges[:-1]]
    if (length != np.repeat(size, n)).any():
        raise ValueError("frames of one tile differ in size")
    for pixels in np.unique(size).tolist():
        own = np.flatnonzero(size == pixels)
        own = own[np.argsort(-n[own], kind="stable")]  # so the tiles that have a t-th frame come first
        many = max(1, STEP_PIXELS // max(pixels, 1))
        for some in (own[i : i + many] for i in range(0, len(own), many)):
            mixture = PixelMixture(len(some) * pixels, params)
            for i, k in enumerate(some.tolist()):
                if models[k] is not None:
                    known = PixelMixture(pixels, params, models[k]).model
                    mixture.model[:, :, i * pixels : (i + 1) * pixels] = known
            row, frames, place = edges[some], n[some], np.arange(pixels)
            left = np.searchsorted(-frames, -np.arange(int(frames[0])), side="left")  # tiles with more than t frames
            for t, active in enumerate(left.tolist()):
                at = (start[row[:active] + t][:, None] + place).ravel()
                masks[at] = mixture.apply_first(data[at])
            for i, k in enumerate(some.tolist()):
                after[k] = mixture.model[:, :, i * pixels : (i + 1) * pixels].tobytes()
    return masks, after


_OUTPUT = "device string, tile int, ts timestamp_ntz, event_id bigint, mask binary, foreground int, model binary"


def subtract_tiles(
    tiled: DataFrame, params: MixtureParams = MixtureParams(), seed: DataFrame | None = None
) -> DataFrame:
    """Foreground mask per frame tile, plus one row per tile with its final ``model``.

    ``seed`` holds the models of earlier frames (``device``, ``tile``, last ``ts``, ``event_id``,
    ``model``).
    """
    columns = ["device", "tile", "ts", "event_id", "data", "model"]
    log = tiled.withColumn("model", F.lit(None).cast("binary")).select(*columns)
    if seed is not None:
        log = log.unionByName(seed.select("device", "tile", "ts", "event_id", "model"), allowMissingColumns=True)
    kind = log.schema["device"].dataType
    kinds = {"device": "string", "tile": "int", "ts": "timestamp_ntz", "event_id": "bigint"}
    in_order = sorted_by_key(log, ["device", "tile"], ["ts", "event_id"]).withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    rows = in_order.mapInArrow(_SubtractTiles(params), _OUTPUT)
    return rows.withColumn("device", F.col("device").cast(kind))


class _SubtractTiles:
    def __init__(self, params: MixtureParams):
        self.params = params

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the tile that goes on: its key, its last row's time and id, and its model
        key, last, model = None, None, None
        for block in _blocks(batches):
            device, tile, ts, event_id, data, seeds = block.columns
            data = data.cast(pa.binary())
            if data.null_count > len(data) - seeds.null_count:
                raise TypeError("a frame without pixels")
            new = np.ones(len(data), bool)
            new[1:] = _differs(device) | _differs(tile)
            goes_on = key == (device[0].as_py(), tile[0].as_py())
            if key is not None and not goes_on:
                yield from self._models([key], [last], [model])
            seeded = seeds.is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(new | seeded)  # a tile's rows begin, or a model that counts from here on
            ends = np.r_[edges[1:], len(new)]
            begin = [seeds[i].as_py() if seeded[i] else None for i in edges.tolist()]
            if goes_on and not seeded[0]:
                begin[0] = model
            _, offsets, pixels = data.buffers()
            offsets = np.frombuffer(offsets, np.int32, len(data) + 1, 4 * data.offset).astype(np.int64)
            pixels = np.frombuffer(pixels, np.uint8)[offsets[0] : offsets[-1]] if pixels is not None else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
            frames = np.flatnonzero(~seeded)
            run = np.searchsorted(edges, frames, side="right") - 1
            first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]][: len(run)])
            used = run[first]
            for i in used.tolist():
                size = len(begin[i]) // (24 * self.params.components) if begin[i] is not None else None
                at = int(edges[i]) + bool(seeded[edges[i]])
                if size is not None and size != offsets[at + 1] - offsets[at]:
                    raise ValueError(f"a frame of {offsets[at + 1] - offsets[at]} pixels for a model of {size}")
            masks, after = subtract_runs(
                pixels, offsets[:-1][frames], np.diff(offsets)[frames], np.r_[first, len(frames)], [begin[i] for i in used.tolist()], self.params
            )
            for i, packed in zip(used.tolist(), after, strict=True):
                begin[i] = packed
            if len(frames):
                yield self._masks(block, masks, offsets, frames)
            done = [i for i, end in enumerate(ends.tolist()) if end < len(new) and new[end]]
            at = ends[done] - 1
            keys = list(zip(device.take(pa.array(at)).to_pylist(), tile.take(pa.array(at)).to_pylist(), strict=True))
            yield from self._models(keys, list(zip(ts.take(pa.array(at)).to_pylist(), event_id.take(pa.array(at)).to_pylist(), strict=True)), [begin[i] for i in done])
            key, last, model = (device[-1].as_py(), tile[-1].as_py()), (ts[-1].as_py(), event_id[-1].as_py()), begin[-1]
        if key is not None:
            yield from self._models([key], [last], [model])

    def _masks(self, block: pa.RecordBatch, masks: np.ndarray, offsets: np.ndarray, frames: np.ndarray) -> pa.RecordBatch:
        total = np.r_[0, np.cumsum(masks, dtype=np.int64)]
        mask = pa.Array.from_buffers(pa.binary(), block.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(masks)])
        foreground = pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int32())
        columns = [*block.columns[:4], mask, foreground, pa.nulls(block.num_rows, pa.binary())]
        found = pa.RecordBatch.from_arrays(columns, _NAMES)
        return found if len(frames) == block.num_rows else found.take(pa.array(frames))

    def _models(self, keys: list[tuple], last: list[tuple], models: list[bytes]) -> Iterator[pa.RecordBatch]:
        """The rows of models, some megabytes at a time."""
        i = 0
        while i < len(keys):
            j = i + max(1, (BLOCK_BYTES << 2) // max(len(models[i]), 1))
            device, tile = zip(*keys[i:j], strict=True)
            ts, event_id = zip(*last[i:j], strict=True)
            kinds = [pa.string(), pa.int32(), pa.timestamp("us"), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip((device, tile, ts, event_id), kinds, strict=True)]
            none = [pa.nulls(len(tile), k) for k in (pa.binary(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *none, pa.array(models[i:j], pa.binary())], _NAMES)
            i = j


_NAMES = ["device", "tile", "ts", "event_id", "mask", "foreground", "model"]


def _differs(values: pa.Array) -> np.ndarray:
    """Of each value but the first, whether it is another than the one before; nulls are equal."""
    same = pc.equal(values[1:], values[:-1]).fill_null(False)
    both = pc.and_(values[1:].is_null(), values[:-1].is_null())
    return ~pc.or_(same, both).to_numpy(zero_copy_only=False)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a stream in blocks of some size."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
        if rows >= BLOCK_ROWS or size >= 8 * BLOCK_BYTES:
            yield from _cut(held)
            held, rows, size = [], 0, 0
    yield from _cut(held)


def _cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    for batch in whole:
        pixels = pc.sum(pc.binary_length(batch.column(4))).as_py() or 0
        step = -(-batch.num_rows // max(1, -(-pixels // BLOCK_BYTES)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def background_subtraction(
    frames: DataFrame, frame_pixels: int, tile_pixels: int = 1024, params: MixtureParams = MixtureParams()
) -> DataFrame:
    """Foreground mask of every frame tile (``device``, ``tile``, ``ts``, ``event_id``, ``mask``)."""
    masks = subtract_tiles(tiles(frames, frame_pixels, tile_pixels), params)
    return masks.where(F.col("mask").isNotNull()).drop("model")


def foreground_pixels(masks: DataFrame) -> DataFrame:
    """Foreground pixels per frame over its tiles."""
    return masks.groupBy("device", "ts", "event_id").agg(F.sum("foreground").alias("fg_pixels"))


def motion_frames(frames: DataFrame, frame_pixels: int, tile_pixels: int = 1024, threshold: int = 5000,
                  params: MixtureParams = MixtureParams()) -> DataFrame:
    """Frames, as they came, with strictly more than ``threshold`` foreground pixels."""
    counted = foreground_pixels(background_subtraction(frames, frame_pixels, tile_pixels, params))
    return frames.join(counted.where(F.col("fg_pixels") > threshold), ["device", "ts", "event_id"])

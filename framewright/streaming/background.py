"""Streaming form of the background model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.background import MixtureParams, foreground_pixels, tiles
from framewright.streaming import keyed as kd

#: From here on a step of one tile costs more by its pixels than by itself.
LANE_PIXELS = 256


def stream_background_subtraction(
    frames: DataFrame, frame_pixels: int, tile_pixels: int = 1024, params: MixtureParams = MixtureParams(),
    path: str | None = None,
) -> DataFrame:
    """Foreground pixels per frame as frames arrive; the state of a device's tile is its mixture.

    Tiles of up to ``LANE_PIXELS`` pixels are worked on by the lane, larger ones each by itself.
    """
    tiled = tiles(frames, frame_pixels, tile_pixels).select("device", "ts", "event_id", "data", "tile")
    tiled = kd.in_lanes(tiled, F.concat_ws(":", "tile", "device")).drop("tile")
    keys = ["_lane"] if tile_pixels <= LANE_PIXELS else ["_lane", "_client"]
    out = T.StructType([*kd._fields(tiled, "device", "ts", "event_id"), T.StructField("foreground", T.IntegerType())])
    step = kd.Background(params)
    path = kd.fresh(frames.sparkSession, path, "background")
    return foreground_pixels(kd.run_keyed(tiled, keys, step, out, step.state, path))

"""Pixel work that needs whole images at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Numbers of output worked on at once: 32 MB in double precision, whatever the batch holds.
SLICE = 4 << 20


def bilinear(images: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Resize (batch, rows, columns, channels); output pixel i samples input place i * in / out."""
    y = np.arange(rows) * (images.shape[1] / rows)
    x = np.arange(columns) * (images.shape[2] / columns)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, images.shape[1] - 1), np.minimum(x0 + 1, images.shape[2] - 1)
    fy, fx = (y - y0)[None, :, None, None], (x - x0)[None, None, :, None]
    top = images[:, y0][:, :, x0] * (1 - fx) + images[:, y0][:, :, x1] * fx
    bottom = images[:, y1][:, :, x0] * (1 - fx) + images[:, y1][:, :, x1] * fx
    return top * (1 - fy) + bottom * fy


def resize_bilinear(rows: int = 250, columns: int = 250):
    """A column function: (height, width, channels, bytes) to the resized image's bytes.

    Images of one size are resized together, as many as SLICE numbers of output hold; values are truncated to bytes.
    """

    @F.pandas_udf("binary")
    def resize(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        out, images = [None] * len(data), data.tolist()
        sizes = pd.DataFrame({"h": height, "w": width, "c": channels})
        for (h, w, c), places in sizes.groupby(["h", "w", "c"]).indices.items():
            many = max(1, SLICE // (max(rows * columns, h * w) * c))
            for i in range(0, len(places), many):
                some = places[i : i + many]
                stacked = np.frombuffer(b"".join(images[p] for p in some), dtype=np.uint8).reshape(len(some), h, w, c)
                resized = bilinear(stacked.astype(np.float64), rows, columns).astype(np.uint8)
                for place, image in zip(some, resized, strict=True):
                    out[place] = image.tobytes()
        return pd.Series(out, dtype=object)

    return resize

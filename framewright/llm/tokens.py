"""Runs of bytes as Arrow values, cut out of whole texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def binary_array(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Values of these lengths that stand one after the other in ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def lower_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Start, end and bytes, A to Z lower-cased, of the longest runs that are ``inside`` and within one text.

    ``offsets`` are those of the texts in ``data``, less than 2 GB.
    """
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = inside[cuts]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:]
    cuts = cuts[cuts > 0] - 1
    ends[cuts] = inside[cuts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, binary_array(end - start, _LOWER[data[inside]])

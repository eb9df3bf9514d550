"""Count-min sketches of partitions, merged, that tell which items may occur twice."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.text import mix, text_slices

#: Lines of the sketch, cells of a line per expected item, and the most cells of a line: the form that is sent to
#: every task takes a bit a cell, so never more than 64 MB. A fuller sketch only lets more items through.
LINES = 2
CELLS_PER_ITEM = 8
MAX_CELLS = 1 << 28
#: Cells of a block, the unit in which partition sketches are merged.
BLOCK = 1 << 16


def cells_for(items: float, per_item: int = CELLS_PER_ITEM) -> int:
    return 1 << min(max(int(items * per_item), 1 << 12).bit_length(), MAX_CELLS.bit_length() - 1)


def _cells(items: np.ndarray, line: int, cells: int) -> np.ndarray:
    return (mix(items + np.uint64((line + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(cells - 1)).astype(np.int64)


def partition_sketches(texts: DataFrame, items_of: Callable[[np.ndarray, np.ndarray], np.ndarray], cells: int) -> DataFrame:
    """The sketch of each partition of ``text`` rows in blocks, counts up to 2; ``items_of`` gives the items of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [items_of(data, offsets) for batch in batches for _, data, offsets in text_slices(batch)]
        items = np.concatenate(items) if items else np.zeros(0, np.uint64)
        for line in range(LINES):
            at = np.sort(_cells(items, line, cells))
            if not len(at):
                continue
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            counts = np.minimum(np.diff(np.r_[new, len(at)]), 2).astype(np.uint8)
            at = at[new]
            blocks, first = np.unique(at // BLOCK, return_index=True)
            bounds = [*first.tolist(), len(at)]
            payloads = []
            for i, block in enumerate(blocks.tolist()):
                dense = np.zeros(min(BLOCK, cells), np.uint8)
                dense[at[bounds[i] : bounds[i + 1]] - block * BLOCK] = counts[bounds[i] : bounds[i + 1]]
                payloads.append(zlib.compress(dense.tobytes(), 1))
            keys = pa.array(np.full(len(blocks), line, np.int32)), pa.array(blocks.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(payloads, pa.binary())], ["line", "block", "part"])

    return texts.select("text").mapInArrow(run, "line int, block bigint, part binary")


def merged(parts: DataFrame, cells: int) -> np.ndarray:
    """A bit a cell and line: whether its count over all partitions is 2 or more."""
    size = min(BLOCK, cells)

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint8)
        for part in group.column(2):
            total = np.minimum(total + np.frombuffer(zlib.decompress(part.as_py()), np.uint8), 2)
        bits = np.packbits(total == 2, bitorder="little").tobytes()
        return pa.table({"line": group.column(0).slice(0, 1), "block": group.column(1).slice(0, 1), "bits": pa.array([bits], pa.binary())})

    found = parts.groupBy("line", "block").applyInArrow(merge, "line int, block bigint, bits binary").toArrow()
    out = np.zeros((LINES, cells // 8), np.uint8)
    for line, block, bits in zip(*(found.column(i).to_pylist() for i in range(3)), strict=True):
        out[line, block * size // 8 : (block + 1) * size // 8] = np.frombuffer(bits, np.uint8)
    return out


def may_repeat(items: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Which items have an estimate of 2 or more; true of every item that was counted twice."""
    passed = np.ones(len(items), bool)
    for line in range(LINES):
        at = _cells(items, line, sketch.shape[1] * 8)
        passed &= (sketch[line][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return passed


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

"""Vectorised words and rolling hashes over the text column of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A word is a run of bytes other than these: space, tab, line feed, vertical tab, form feed, return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SEED = np.random.default_rng(20260101)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20
_BLOCK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = _SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows of about ``size`` bytes: (first row, bytes, row offsets).

    A null text has no bytes. A single longer text is a run of its own.
    """
    array = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(array.type):
        array = array.cast(pa.string())
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()[:3]
    if not len(array):
        return
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    offsets = np.frombuffer(offsets, kind, len(array) + 1, array.offset * width).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(array))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of some texts: ``start`` and ``end`` are byte positions, ``row`` the text,
    ``first[i]:first[i + 1]`` the words of text ``i``, ``hash`` 64 bits of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        word = ~_SPACE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cuts = offsets[:-1]
        cuts = cuts[cuts < len(data)]
        begins[cuts] = word[cuts]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        cuts = offsets[1:]
        cuts = cuts[cuts > 0] - 1
        ends[cuts] = word[cuts]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = self._hash(lower)

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self, lower: bool) -> np.ndarray:
        """Per word the sum of random values of its bytes times powers of an odd base, mixed; block by block."""
        table = _BYTE[_LOWER] if lower else _BYTE
        out = np.empty(len(self.start), np.uint64)
        lengths = self.end - self.start
        power = powers(int(lengths.max())) if len(lengths) else None
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + _BLOCK, side="right")))
            n = lengths[i:j]
            at = np.cumsum(n) - n
            inside = np.arange(int(n.sum())) - np.repeat(at, n)
            values = table[self.data[inside + np.repeat(self.start[i:j], n)]] * power[inside]
            out[i:j] = np.add.reduceat(values, at) + n.astype(np.uint64)
            i = j
        return mix(out)


def window_hash(values: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of every run of ``width`` consecutive values, in one pass whatever the width.

    Prefix sums of value times base**position are subtracted and scaled back by the inverse of the
    odd base, in arithmetic modulo 2**64.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = int(base) | 1
    power = powers(len(values), np.uint64(odd))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power, out=total[1:])
    back = powers(n, np.uint64(pow(odd, -1, 1 << 64)))
    return mix((total[width:] - total[:-width]) * back)


def whole_windows(words: Words, width: int) -> np.ndarray:
    """Which of the ``len(words) - width + 1`` windows lie within one text."""
    n = len(words) - width + 1
    return words.row[:n] == words.row[width - 1 :] if n > 0 else np.zeros(0, bool)

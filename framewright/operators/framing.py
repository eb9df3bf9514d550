"""Length-prefixed byte logs back to messages.

Segments of a connection are cut anywhere, so where a message starts depends on everything
before. Ordinary connections are read as one sorted stream per connection, holding one
unfinished message. A hot connection is cut into ordered chunks: each chunk guesses its first
message start from the bytes, all chunks are measured at once, and the chain of chunk ends then
proves or refutes each guess. Refuted chunks are measured again from the proven start, so the
result never depends on a guess; a message across chunks is put together from its fragments.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.messages import CLIENT_TAGS, MAX_MESSAGE, SERVER_TAGS
from framewright.operators.ordering import KeyedScan, sorted_by_key

_KNOWN_TAGS = frozenset(SERVER_TAGS) | frozenset(CLIENT_TAGS)
_LOOK_AHEAD = 1 << 16
_SYNC_MESSAGES = 8


@dataclass
class Cursor:
    """Place in a log: header bytes read so far, body bytes still due, or a fault."""

    head: bytes = b""
    due: int = 0
    failed: bool = False

    def advance(self, data: bytes, limit: int) -> list[tuple[bool, bool, int, int]]:
        """Move over ``data``; the pieces of messages in it as (starts, ends, from, to)."""
        pieces, pos, size = [], 0, len(data)
        while pos < size and not self.failed:
            begin, starts = pos, self.due == 0 and not self.head
            if self.due == 0:
                pos = min(size, begin + 4 - len(self.head))
                self.head += data[begin:pos]
                if len(self.head) < 4:
                    pieces.append((starts, False, begin, pos))
                    break
                self.due = int.from_bytes(self.head, "big", signed=True)
                self.head = b""
                if not 0 <= self.due <= limit:
                    self.failed = True
                    pieces.append((starts, False, begin, pos))
                    break
            step = min(self.due, size - pos)
            pos += step
            self.due -= step
            pieces.append((starts, self.due == 0, begin, pos))
        return pieces


def guess_start(data: bytes, limit: int) -> int:
    """First offset from which message headers follow one another, 0 if none shows."""
    for offset in range(len(data) - 8):
        pos, found = offset, 0
        while pos + 8 <= len(data) and found < _SYNC_MESSAGES:
            size = int.from_bytes(data[pos : pos + 4], "big")
            tag = int.from_bytes(data[pos + 4 : pos + 8], "big")
            if not 4 <= size <= limit or tag not in _KNOWN_TAGS:
                break
            pos, found = pos + 4 + size, found + 1
        else:
            return offset
    return 0


def _runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[bool, tuple]]:
    """Rows of sorted batches with a flag on the first of each key."""
    last = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            key = tuple(getattr(row, k) for k in keys)
            yield key != last, row
            last = key


class _Whole:
    """Messages of connections read from their first byte."""

    def __init__(self, limit: int):
        self.limit = limit

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def finish():
            if cursor.failed:
                out.append((conn, count - 1, None, "too long"))
            elif buffer:
                out.append((conn, count - 1, None, "truncated"))

        conn, cursor, buffer, count, out = None, None, bytearray(), 0, []
        for first, row in _runs(batches, ["conn"]):
            if first:
                if cursor is not None:
                    finish()
                conn, cursor, buffer, count = row.conn, Cursor(), bytearray(), 0
            for starts, ends, begin, stop in cursor.advance(row.data, self.limit):
                count += starts
                buffer += row.data[begin:stop]
                if ends:
                    out.append((conn, count - 1, bytes(buffer[4:]), None))
                    buffer.clear()
            if len(out) >= 10_000:
                yield _messages(out)
                out = []
        if cursor is not None:
            finish()
        yield _messages(out)


def _messages(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conn", "msg", "wire", "error"])


class _Measure:
    """Per chunk: the entry used, messages started and the place at its end."""

    def __init__(self, limit: int):
        self.limit = limit

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, group, entry, held, count, cursor = [], None, None, bytearray(), 0, None

        def start():
            nonlocal cursor, entry, count, held
            if cursor is None:
                entry = (b"", guess_start(bytes(held), self.limit))
                cursor = Cursor(due=entry[1])
            count += sum(piece[0] for piece in cursor.advance(bytes(held), self.limit))
            held = bytearray()

        def finish():
            if held or cursor is None:
                start()
            out.append((*group, *entry, count, cursor.head, cursor.due, cursor.failed))

        for first, row in _runs(batches, ["conn", "chunk"]):
            if first:
                if group is not None:
                    finish()
                group, held, count, cursor, entry = (row.conn, row.chunk), bytearray(), 0, None, None
                if row.head is not None:
                    entry = (row.head, int(row.due))
                    cursor = Cursor(row.head, int(row.due))
            held += row.data
            if cursor is not None or len(held) >= _LOOK_AHEAD:
                start()
        if group is not None:
            finish()
        names = ["conn", "chunk", "head", "due", "started", "end_head", "end_due", "failed"]
        yield pd.DataFrame(out, columns=names)


class _Pieces:
    """From known entries: the messages inside a chunk, or the fragments at its edges."""

    def __init__(self, limit: int, fragments: bool):
        self.limit = limit
        self.fragments = fragments

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def fragment(ended: bool):
            if self.fragments and (buffer or cursor.failed):
                out.append((*group, count - 1, bytes(buffer), ended, cursor.failed))

        out, group, cursor, buffer, count, inside = [], None, None, bytearray(), 0, False
        for first, row in _runs(batches, ["conn", "chunk"]):
            if first:
                if group is not None:
                    fragment(False)
                group, cursor = (row.conn, row.chunk), Cursor(row.head, int(row.due))
                buffer, count, inside = bytearray(), int(row.base), False
            for starts, ends, begin, stop in cursor.advance(row.data, self.limit):
                count += starts
                inside |= starts
                buffer += row.data[begin:stop]
                if ends:
                    if not inside:
                        fragment(True)
                    elif not self.fragments:
                        out.append((*group, count - 1, bytes(buffer[4:]), True, False))
                    buffer.clear()
                    inside = False
            if len(out) >= 10_000:
                yield self._frame(out)
                out = []
        if group is not None:
            fragment(False)
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conn", "chunk", "msg", "wire", "ended", "failed"])


def split_frames(
    segments: DataFrame,
    order: tuple[str, ...] = ("seq",),
    max_message: int = MAX_MESSAGE,
    hot_rows: int | None = None,
) -> DataFrame:
    """Messages (``conn``, ``msg``, ``wire``, ``error``) of segments (``conn``, order, ``data``).

    A length above ``max_message`` ends the connection with an error row; bytes left over at the
    end give a ``truncated`` row. ``order`` must be unique within a connection.
    """
    kind = segments.schema["conn"].dataType
    # as text through Python, where large integers beside a null would be rounded
    texts = segments.withColumn("conn", F.col("conn").cast("string"))
    messages = _split(texts, order, max_message, hot_rows)
    return messages.withColumn("conn", F.col("conn").cast(kind))


def _split(segments: DataFrame, order: Sequence[str], max_message: int, hot_rows: int | None) -> DataFrame:
    conn_type = segments.schema["conn"].dataType.simpleString()
    schema = f"conn {conn_type}, msg bigint, wire binary, error string"
    scan = KeyedScan(segments.select("conn", *order, "data"), ["conn"], order, hot_rows)
    cold = scan.rows.where(F.col("_chunk") == 0) if scan.split else scan.rows
    in_order = sorted_by_key(cold, ["conn"], order).select("conn", "data")
    whole = in_order.mapInPandas(_Whole(max_message), schema)
    if not scan.split:
        return whole
    hot = scan.rows.where(F.col("_chunk") > 0).withColumnRenamed("_chunk", "chunk")
    entries = _resolve_entries(hot, order, max_message, conn_type)
    pieces_schema = f"conn {conn_type}, chunk int, msg bigint, wire binary, ended boolean, failed boolean"

    def pieces(fragments: bool) -> DataFrame:
        return _by_chunk(hot, entries, order).mapInPandas(_Pieces(max_message, fragments), pieces_schema)

    inside = pieces(False).select("conn", "msg", "wire", F.lit(None).cast("string").alias("error"))
    # a message has at most max_message bytes, so has the group of its fragments
    joined = (
        pieces(True)
        .groupBy("conn", "msg")
        .agg(
            F.sort_array(F.collect_list(F.struct("chunk", "wire"))).alias("parts"),
            F.max("ended").alias("ended"),
            F.max("failed").alias("failed"),
        )
    )
    raw = F.aggregate("parts", F.lit(b""), lambda acc, part: F.concat(acc, part["wire"]))
    across = joined.select(
        "conn",
        "msg",
        F.when(F.col("ended"), F.substr(raw, F.lit(5))).alias("wire"),
        F.when(F.col("failed"), "too long").when(~F.col("ended"), "truncated").alias("error"),
    )
    return whole.unionByName(inside).unionByName(across)


def _by_chunk(hot: DataFrame, entries: DataFrame, order: Sequence[str]) -> DataFrame:
    """Chunk rows with their entry, each chunk in order within one partition."""
    same = hot["conn"].eqNullSafe(entries["conn"]) & (hot["chunk"] == entries["chunk"])
    entered = hot.join(entries, same).select(
        hot["conn"], hot["chunk"], *[hot[c] for c in order], "data", "head", "due", "base"
    )
    return sorted_by_key(entered, ["conn", "chunk"], order)


def _resolve_entries(hot: DataFrame, order: Sequence[str], limit: int, conn_type: str) -> DataFrame:
    """The proven entry of every chunk: one small row per chunk, at most a few ten thousand."""
    spark = hot.sparkSession
    entry_schema = T.StructType(
        [
            hot.schema["conn"],
            T.StructField("chunk", T.IntegerType()),
            T.StructField("head", T.BinaryType()),
            T.StructField("due", T.LongType()),
            T.StructField("base", T.LongType()),
        ]
    )
    measured_schema = (
        f"conn {conn_type}, chunk int, head binary, due bigint, started bigint, "
        "end_head binary, end_due bigint, failed boolean"
    )
    chunks: dict = {}
    for row in hot.select("conn", "chunk").distinct().collect():
        chunks.setdefault(row["conn"], []).append(row["chunk"])
    for numbers in chunks.values():
        numbers.sort()
    # first round: the first chunk of a connection starts at a message, the others guess
    todo = [(c, n, b"" if n == ns[0] else None, 0, 0) for c, ns in chunks.items() for n in ns]
    measured: dict = {}
    while todo:
        rows = _by_chunk(hot, spark.createDataFrame(todo, entry_schema), order)
        for r in rows.mapInPandas(_Measure(limit), measured_schema).collect():
            measured[r["conn"], r["chunk"]] = r
        todo, proven = [], []
        for conn, numbers in chunks.items():
            head, due, base = b"", 0, 0
            for n in numbers:
                r = measured[conn, n]
                if (bytes(r["head"]), r["due"]) != (head, due):
                    todo.append((conn, n, head, due, 0))
                    break
                proven.append((conn, n, head, due, base))
                if r["failed"]:
                    break
                head, due, base = bytes(r["end_head"]), r["end_due"], base + r["started"]
    return spark.createDataFrame(proven, entry_schema)

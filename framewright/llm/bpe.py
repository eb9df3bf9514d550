"""Byte-level BPE encoding and decoding by a tree reduction over the text."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm.components import prepare

#: Characters of a leaf, which the library encodes at once. An ordinary text has several.
LEAF = 512
#: Characters each side of a joint that the first re-encoded window looks at.
WINDOW = 16

# A window begins and ends between a character that is no white space and white space after it. The patterns of this kind of
# vocabulary never match white space behind another character, and no match before the cut looks further than the
# white space, so left of such a cut and right of it the tokens depend on their side alone. A pattern that does match over
# such a place is refused.
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def check_pattern(pattern: str) -> None:
    """ValueError for a pattern with a match over the places where windows begin and end."""
    import regex

    find = regex.compile(pattern).finditer
    for before in ("a", "Z", "7", ".", "'", "-", "_", "$", "\u00e9", "\u4e2d", "\U0001f600", "e\u0301"):
        for space in " \t\n\r":
            for after in ("", "b", "7", ".", " ", "\n", "\u4e2d"):
                for first in ("", "x", "1", ".", " "):
                    cut = len(first + before)
                    if any(m.start() < cut < m.end() for m in find(first + before + space + after)):
                        raise ValueError("the pattern matches white space together with what stands before it")


class ByteBpe:
    """A byte-level vocabulary of tiktoken's rank file format."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        check_pattern(pattern)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """The ids of a text: halves are encoded recursively and joined."""
        return self._encode(text, 0, len(text), max(leaf, 2))

    def _encode(self, text: str, start: int, end: int, leaf: int) -> list[int]:
        if end - start <= leaf:
            return self._leaf(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._encode(text, start, middle, leaf), self._encode(text, middle, end, leaf))

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of its two parts.

        A window around the joint grows on each side until it begins and ends at a cut, or at the part's edge, and until
        the part's own tokens there are those of the window alone: tokens outside have then settled, whatever
        stands beyond the joint. Those inside are encoded again.
        """
        first, size = middle, WINDOW
        while True:
            first, size = self._before(text, start, first, middle - size), 2 * size
            dropped = self._leaf(text[first:middle])
            if first == start or left[len(left) - len(dropped) :] == dropped:
                break
        last, size = middle, WINDOW
        while True:
            last, size = self._after(text, end, last, middle + size), 2 * size
            skipped = self._leaf(text[middle:last])
            if last == end or right[: len(skipped)] == skipped:
                break
        return left[: len(left) - len(dropped)] + self._leaf(text[first:last]) + right[len(skipped) :]

    @staticmethod
    def _before(text: str, start: int, at: int, reach: int) -> int:
        """The last cut between ``reach`` and ``at``, or the last one before; ``start`` if there is none."""
        size = WINDOW
        while reach > start:
            found = max((m.start() for m in _CUT.finditer(text, reach, at) if m.start() < at), default=start)
            if found > start:
                return found
            reach, size = reach - size, 2 * size
        return start

    @staticmethod
    def _after(text: str, end: int, at: int, reach: int) -> int:
        """The first cut between ``at`` and ``reach``, or the first one behind; ``end`` if there is none."""
        size = WINDOW
        while reach < end:
            found = min((m.start() for m in _CUT.finditer(text, at, reach) if m.start() > at), default=end)
            if found < end:
                return found
            reach, size = reach + size, 2 * size
        return end

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        """The bytes of some ids: leaves are concatenated, then neighbours up the tree."""
        parts = [b"".join(map(self.tokens.__getitem__, ids[i : i + leaf])) for i in range(0, len(ids), leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


Finish = Callable[[list[list[int]], list[bytes]], list[pa.Array]]


def ids_and_bytes(ids: list[list[int]], decoded: list[bytes]) -> list[pa.Array]:
    return [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]


def encode_decode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    finish: Finish = ids_and_bytes,
    schema: str = "ids array<int>, decoded binary",
    leaf: int = LEAF,
) -> DataFrame:
    """Per row its id, the ids of its whole text and the bytes these decode to; other columns are left out.

    A null or empty text has no ids and no bytes. Repeated rows each get their own. ``finish`` turns the
    ids and bytes of some rows into the columns of ``schema``, so that what only a digest is wanted
    of need not leave the worker. Rows are worked on one by one: memory holds one slice of rows.
    """
    prepare(docs.sparkSession)
    source = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, begun = [], 0, at
                while at < batch.num_rows and size < 1 << 20:
                    text = batch.column(1)[at].as_py() or ""
                    texts.append(text)
                    size += len(text)
                    at += 1
                ids = [bpe.encode(t, leaf) for t in texts]
                columns = finish(ids, [bpe.decode(x) for x in ids])
                names = ["doc_id", *(f"c{i}" for i in range(len(columns)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begun, at - begun), *columns], names)

    kind = source.schema["doc_id"].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [part.split(" ", 1)[1] for part in schema.split(", ")]
    out = source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return out.toDF("doc_id", *names)

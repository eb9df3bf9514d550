"""Conversations rendered as training text, with a loss mask over the tokens of their assistant turns."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.components import prepare

#: A turn is ``<turn>`` role ``<text>`` text ``</turn>``. The three are single tokens behind the vocabulary, so a cut
#: between tokens lies on each side of every role and text.
CONTROL = ("<turn>", "<text>", "</turn>")
_RAW = re.compile(r"<(\\*)(turn>|text>|/turn>)")
_ESCAPED = re.compile(r"<\\(\\*)(turn>|text>|/turn>)")
_TURN = re.compile(r"<turn>(.*?)<text>(.*?)</turn>", re.DOTALL)

#: Characters from which on a conversation goes on in a further part, so that a task holds one part. Parts are cut
#: between turns.
PART_CHARS = 4 << 20


def escape(text: str) -> str:
    """The text with one backslash more behind the bracket of everything that looks like a control string."""
    return _RAW.sub(lambda m: "<\\" + m[1] + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1] + m[2], text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


class ChatVocabulary:
    """A byte-level vocabulary of tiktoken's rank file format with the control strings as its next ids."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        first = max(ranks.values()) + 1
        special = {name: first + i for i, name in enumerate(CONTROL)}
        self.tokens = [b""] * (first + len(CONTROL))
        for token, rank in ranks.items():
            self.tokens[rank] = token
        for name, rank in special.items():
            self.tokens[rank] = name.encode()
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self._encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a rendered text, and where in its bytes each token ends."""
        ids = np.array(self._encoding.encode(text, allowed_special="all"), np.int32)
        return ids, np.cumsum(self.lengths[ids])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def chat_vocabulary(path: str, pattern: str) -> ChatVocabulary:
    return ChatVocabulary(path, pattern)


def token_spans(ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each span of bytes the tokens that lie wholly in it, by binary search over the tokens' offsets."""
    starts = np.r_[0, ends[:-1]]
    return np.stack([np.searchsorted(starts, spans[:, 0], "left"), np.searchsorted(ends, spans[:, 1], "right")], axis=1)


class _Part:
    """Turns of one conversation, rendered one behind the other."""

    def __init__(self):
        self.pieces: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.chars = self.bytes = self.turns = 0

    def add(self, role: str, text: str, learned: bool) -> None:
        head, body, tail = f"<turn>{escape(role)}<text>", escape(text), "</turn>"
        begin = self.bytes + len(head.encode())
        end = begin + len(body.encode())
        if learned and end > begin:
            self.spans.append((begin, end))
        self.pieces += head, body, tail
        self.bytes = end + len(tail)
        self.chars += len(head) + len(body) + len(tail)
        self.turns += 1


_SCHEMA = "part bigint, whole boolean, n_turns bigint, formatted string, ids array<int>, loss array<struct<first:int,end:int>>"
_LOSS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def format_conversations(
    conversations: DataFrame, path: str, pattern: str, learned: str = "assistant", part_chars: int = PART_CHARS
) -> DataFrame:
    """Each conversation as text, token ids and loss mask.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are left out. Turns are taken by
    number, null first; rows of one number by role, then by a hash of the text. A null role or text is empty, rows without an id are one
    conversation, repeated rows are turns of their own, and an empty table gives no rows.

    ``formatted`` is rendered whole and encoded once. ``loss`` lists ranges of tokens: those of each text of
    the role ``learned``, in order; the tokens' offsets and the turns' are both sorted, so a binary search finds them. Empty
    texts have no range. Rows are dealt out by ranges of (conversation, turn), so a conversation of any
    length is worked on by several tasks: it then has several rows, ``part`` rising along its turns, and so has one
    of more than ``part_chars``. ``whole`` marks rows that are surely all of their conversation.
    """
    prepare(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    ).withColumn("_tie", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "_tie"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = chat_vocabulary(path, pattern)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        part, conv, opened, done = None, None, True, []
        size = 0

        def leave(whole: bool) -> None:
            nonlocal number, size
            formatted = "".join(part.pieces)
            ids, ends = vocabulary.encode(formatted)
            loss = token_spans(ends, np.array(part.spans, np.int64).reshape(-1, 2))
            done.append((conv, number, whole, part.turns, formatted, ids, loss))
            number += 1
            size += part.bytes

        def batch_of() -> pa.RecordBatch:
            nonlocal done, size
            columns = list(zip(*done, strict=True))
            done, size = [], 0
            arrays = [
                pa.array(columns[0], kinds), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.int64()),
                pa.array(columns[4], pa.string()), pa.array(columns[5], pa.list_(pa.int32())),
                pa.array([[(int(a), int(b)) for a, b in x] for x in columns[6]], _LOSS),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *(c.split()[0] for c in _SCHEMA.split(", "))])

        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            for own, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if part is not None and own != conv:
                    leave(not opened)
                    part, opened = None, False
                elif part is not None and part.chars >= part_chars:
                    leave(False)
                    part, opened = None, True
                if size >= 1 << 20:
                    yield batch_of()
                if part is None:
                    part, conv = _Part(), own
                part.add(role, text.as_py(), role == learned)
        if part is not None:
            leave(False)  # it may go on in the next range
        if done:
            yield batch_of()

    return ranges.mapInArrow(run, f"conv_id {kind}, {_SCHEMA}")


def masked_text(vocabulary: ChatVocabulary, ids: list[int], loss: list[dict]) -> str:
    """The text under a loss mask, read from the tokens."""
    return "".join(unescape(vocabulary.decode(ids[s["first"] : s["end"]]).decode()) for s in loss)


_DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(turns: int, turns_hash, loss_chars: int, loss_hash, chars: int) -> tuple:
    return turns, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars


def conversation_digests(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per conversation what can be read back from its rows of ``format_conversations``: turns from the text, what is
    learned from tokens and mask.

    A row that is a whole conversation gets its digests at once. A digest must see the text in order, so the
    parts of the others are then brought together by conversation and sorted; they stream through, one part at a time.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = chat_vocabulary(path, pattern)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                whole, text, ids, loss = (batch.column(c)[i].as_py() for c in ("whole", "formatted", "ids", "loss"))
                turns = read_turns(text)
                said = "".join(f"{role}\n{said}\n" for role, said in turns).encode()
                learned = masked_text(vocabulary, ids, loss)
                counts = len(turns), len(learned), len(text)
                raw = learned.encode()
                if whole:
                    out.append((*counts, hashlib.sha256(said).hexdigest(), hashlib.sha256(raw).hexdigest(), None, None))
                else:
                    out.append((*counts, None, None, said, raw))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("part"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["conv_id", "part", "turns", "loss", "chars", "turns_hash", "loss_hash", "said", "learned"],
            )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None
        for batch in batches:
            ids, out = [], []
            for i in range(batch.num_rows):
                own, _, turns, loss, chars, turns_hash, loss_hash, said, learned = (batch.column(c)[i].as_py() for c in range(9))
                if held is not None and (own != conv or turns_hash is not None):
                    ids.append(conv)
                    out.append(_digests(*held))
                    held = None
                if turns_hash is not None:
                    ids.append(own)
                    out.append((turns, turns_hash, loss, loss_hash, chars))
                    continue
                if held is None:
                    conv, held = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[0] += turns
                held[1].update(said)
                held[2] += loss
                held[3].update(learned)
                held[4] += chars
            if out:
                yield digest_batch(ids, out, batch.schema.field(0).type)
            kinds = batch.schema.field(0).type
        if held is not None:
            yield digest_batch([conv], [_digests(*held)], kinds)

    def digest_batch(ids: list, out: list, kinds: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(ids, kinds), *(pa.array(c) for c in zip(*out, strict=True))]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *(c.split()[0] for c in _DIGESTS.split(", "))])

    pieces = "turns bigint, loss bigint, chars bigint, turns_hash string, loss_hash string, said binary, learned binary"
    found = formatted.mapInArrow(parts, f"conv_id {kind}, part bigint, {pieces}")
    together = found.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return together.mapInArrow(joined, f"conv_id {kind}, {_DIGESTS}")

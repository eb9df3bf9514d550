"""Token sequences written in a keyed training order as fixed-stride binary shards."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.components import prepare, stored
from framewright.llm.text import mix
from framewright.session import open_filesystem, work_path

#: Ids of a sequence and bytes of a shard, about.
LENGTH = 512
SHARD_BYTES = 16 << 20
ROUNDS = 6
#: Ids are below this many unless a larger vocabulary is named.
VOCABULARY = 1 << 16

Encode = Callable[[str], list[int]]


def number_type(vocabulary: int, length: int = LENGTH) -> np.dtype:
    """A record is the number of its ids, then ``length`` ids, those past the number zero; little-endian and unsigned, of
    16 bits where these hold all ids of the vocabulary, else of 32."""
    return np.dtype("<u2" if max(vocabulary - 1, length) < 1 << 16 else "<u4")


def feistel(index: np.ndarray, size: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0..size-1.

    A balanced Feistel network permutes the least square of a power of two that holds ``size``; results beyond
    ``size`` are put in again until they fall below, which keeps it a permutation.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "big")) for r in range(rounds)]
    out, left = index.astype(np.uint64), np.arange(len(index))
    while len(left):
        a, b = out[left] >> shift, out[left] & mask
        for k in keys:
            a, b = b, a ^ (mix(b ^ k) & mask)
        out[left] = (a << shift) | b
        left = left[out[left] >= np.uint64(size)]
    return out


def _sequences(docs: DataFrame, encoder: Callable[[], Encode], length: int, width: np.dtype, per_doc: int, size: int, key: int, shards: int) -> DataFrame:
    """One row a sequence of (number, doc_id, text): its shard, its place in the permuted order, where it comes from and
    its compressed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, codec = encoder(), pa.Codec("zstd", 1)
        for batch in batches:
            bases, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            rows, size_ = [], 0
            for i, (base, doc) in enumerate(zip(bases, ids, strict=True)):
                tokens = np.array(encode(texts[i].as_py() or ""), width)
                for number in range((len(tokens) + length - 1) // length):
                    part = tokens[number * length : (number + 1) * length]
                    rows.append((base, doc, number, len(part), codec.compress(part.tobytes(), asbytes=True)))
                    size_ += len(part)
                if rows and (size_ > 1 << 20 or i == len(ids) - 1):
                    base_, doc_, number_, n_, payload = zip(*rows, strict=True)
                    index = np.array(base_, np.uint64) * np.uint64(per_doc) + np.array(number_, np.uint64)
                    place = feistel(index, size, key)
                    shard = (place // np.uint64((size + shards - 1) // shards)).astype(np.int32)
                    columns = [pa.array(shard), pa.array(place.astype(np.int64)), pa.array(doc_, pa.int64())]
                    columns += [pa.array(number_, pa.int64()), pa.array(n_, pa.int64()), pa.array(payload, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "place", "doc_id", "seq_no", "n_ids", "ids"])
                    rows, size_ = [], 0

    return docs.mapInArrow(run, "shard int, place bigint, doc_id bigint, seq_no bigint, n_ids bigint, ids binary")


def _written(ordered: DataFrame, folder: str, length: int, width: np.dtype) -> DataFrame:
    """Writes each partition, one shard in order, and returns a row a record with its position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, out, at, draft, name = pa.Codec("zstd", 1), None, 0, "", ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"{folder}/shard-{batch.column(0)[0].as_py():06d}.bin"
                fs, path = open_filesystem(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                draft = f"{path}.{uuid.uuid4().hex}.part"
                out = fs.open_output_stream(draft)
            n = batch.column(4).to_numpy()
            records = np.zeros((batch.num_rows, length + 1), width)
            records[:, 0] = n
            for i, ids in enumerate(batch.column(5)):
                raw = codec.decompress(ids.as_buffer(), decompressed_size=int(n[i]) * width.itemsize)
                records[i, 1 : n[i] + 1] = np.frombuffer(raw, width)
            out.write(records.tobytes())
            position = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            columns = [batch.column(0), position, *(batch.column(c) for c in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "position", "doc_id", "seq_no", "n_ids"])
        if out is not None:
            # A shard takes its name when it is whole; a task that runs again writes the same bytes.
            out.close()
            fs.move(draft, path)

    return ordered.mapInArrow(run, "shard int, position bigint, doc_id bigint, seq_no bigint, n_ids bigint")


def training_order(
    docs: DataFrame,
    encoder: Callable[[], Encode],
    key: int,
    folder: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    shard_bytes: int = SHARD_BYTES,
    vocabulary: int = VOCABULARY,
) -> tuple[DataFrame, str]:
    """Write the sequences of all documents as shards; returns their index (slot, shard, position, doc_id, seq_no, n_ids)
    and the folder.

    Each text's ids, from ``encoder()`` made once a task, are cut into sequences of ``length``. A sequence is numbered by its
    document's id and its place in it, so its number depends on no partitioning; the keyed permutation
    of all possible numbers gives its place, and its slot is the rank of its place. A shard is a range of places,
    known beforehand, so one shuffle without sampling brings every sequence to the task that writes it. Records
    have one stride: slot s is record s - first_slot of the shard whose range holds s (see ``manifest``).

    A null or empty text has no sequence. Rows with a null id are numbered behind the others by a hash of their text. Rows
    that share an id, or a text without an id, stand next to each other in the order, each with its own slot. ``encoder``
    must give ids below ``vocabulary``, else OverflowError where the record's numbers cannot hold them (see
    ``number_type``); ids of documents may span at most 2**62 divided by the most sequences of a document, else ValueError.
    ``folder`` must be shared; an empty table writes no shard; other columns, whatever their names, are left alone.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or work_path(spark, "training-order")
    texts = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    texts = texts.where("text != ''")
    # An id stands for one byte at least, so a text has no more sequences than its bytes allow.
    octets = F.octet_length("text").cast("bigint")
    unnamed = F.count_if(F.col("doc_id").isNull())
    low, high, most, total, nameless = texts.agg(F.min("doc_id"), F.max("doc_id"), F.max(octets), F.sum(octets), unnamed).first()
    low, high, most, total = low or 0, -1 if high is None else high, most or 1, total or 0
    per_doc = -(-most // length)
    span = high - low + 1 if high >= low else 0
    size = max(1, span + nameless) * per_doc
    if size > 1 << 62:
        raise ValueError("document ids span too wide a range; number the documents first")
    shards = max(1, -(-total // shard_bytes))
    behind = F.lit(span) + F.pmod(F.xxhash64("text"), F.lit(max(1, nameless)))
    numbered = texts.select(F.coalesce(F.col("doc_id") - low, behind).alias("number"), "doc_id", "text")
    width = number_type(vocabulary, length)
    rows = _sequences(numbered, encoder, length, width, per_doc, size, key, shards)
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("place", "doc_id", "seq_no", "ids")
    index = stored(_written(dealt, folder, length, width), "training-index")
    starts = manifest(index).select("shard", "first_slot")
    placed = index.join(starts, "shard")
    columns = ["shard", "position", "doc_id", "seq_no", "n_ids"]
    return placed.select((F.col("first_slot") + F.col("position")).alias("slot"), *columns), folder


def manifest(index: DataFrame) -> DataFrame:
    """One row a shard: how many records it has and the slot of its first."""
    counts = index.groupBy("shard").agg(F.count("*").alias("n_records"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_slot", F.coalesce(F.sum("n_records").over(before), F.lit(0)))


def read_slots(
    folder: str, shards: list[tuple[int, int, int]], first: int, length: int = LENGTH, vocabulary: int = VOCABULARY
) -> Iterator[np.ndarray]:
    """The sequences from slot ``first`` on, in order; ``shards`` are the manifest's (shard, n_records, first_slot).

    A reader that stopped goes on from any slot: it skips whole shards and seeks in one.
    """
    width = number_type(vocabulary, length)
    stride = (length + 1) * width.itemsize
    for shard, n, start in sorted(shards, key=lambda s: s[2]):
        if first >= start + n:
            continue
        fs, path = open_filesystem(f"{folder}/shard-{shard:06d}.bin")
        with fs.open_input_file(path) as file:
            file.seek(max(0, first - start) * stride)
            while len(record := file.read(stride)) == stride:
                ids = np.frombuffer(record, width)
                yield ids[1 : ids[0] + 1]

"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.components import bit_filter, in_filter, prepare
from framewright.llm.text import Words, mix, text_slices
from framewright.session import pin

#: The fixed masks: 1 takes part in the hash, 0 is ignored. Any two of the ten places are ignored by some mask, so together
#: they hit any ten words in a row of which two are replaced. An item of 10 to 14 words counts as found from overlaps that
#: all hold such ten words, so none of these is missed (tests/llm tries all cases).
MASKS = (
    "0010111101", "0101100111", "0111011010", "1001011011", "1011100110", "1100111100", "1110010101", "1110101001", "1111000011",
)
#: Places beyond either end of a document that windows reach to, and what stands there: no word. An item may end with two
#: words that the document lacks.
BEYOND = 2
_NO_WORD = np.uint64(0xD1B54A32D192ED03)
#: Words that must agree in the overlap around a hit, and their least share of it.
MIN_MATCHES = 10
MIN_SHARE = 0.8
#: Items shorter than the masks are looked for as they are: anywhere from this many words, and below, where they are common
#: phrases, as whole documents.
PHRASE = 5
#: Bits of the filter that goes to every task: a fixed size, whatever the benchmark's.
FILTER_BITS = 1 << 24


def masked(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash under one mask of every window of its span."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, number + 1, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(total)


def _seeds(
    words: Words, masks: tuple[str, ...], lengths: Sequence[int], phrase: int, beyond: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all windows of each text, under every mask, the text, and the place of the word each starts at; and
    of all windows of the given lengths, those of fewer than ``phrase`` words only if they are the whole text. Windows of
    masks reach ``beyond`` places over a text's ends."""
    counts = np.diff(words.first)
    shift = beyond * (2 * words.row + 1)
    padded = np.full(len(words) + 2 * beyond * len(counts), _NO_WORD)
    padded[np.arange(len(words)) + shift] = words.hash
    of = np.repeat(np.arange(len(counts)), counts + 2 * beyond)
    first = words.first[:-1] + 2 * beyond * np.arange(len(counts)) + beyond
    hashes, rows, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, mask in enumerate(masks):
        h = masked(padded, mask, number)
        if len(h):
            at = np.flatnonzero(of[: len(h)] == of[len(mask) - 1 :])
            hashes.append(h[at])
            rows.append(of[at])
            places.append(at - first[of[at]])
    for length in lengths:
        h = masked(words.hash, "1" * length, len(masks) + length)
        if len(h):
            row = words.row[: len(h)]
            at = np.flatnonzero((row == words.row[length - 1 :]) & ((counts[row] == length) | (length >= phrase)))
            hashes.append(h[at])
            rows.append(row[at])
            places.append(at - words.first[row[at]])
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(places)


def _table(frame: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return frame.select(frame[id_column].alias("id"), frame[text_column].cast("string").alias("text"))


_HITS = "array<struct<hash: bigint, pos: bigint>>"


def _hit_struct(hashes: np.ndarray, pos: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(pos.astype(np.int64))], ["hash", "pos"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _seed_rows(
    frame: DataFrame, masks: tuple[str, ...], lengths: Sequence[int], phrase: int, beyond: int = 0, wanted=None
) -> DataFrame:
    """Per row with seeds its id, the hashes of its words and its seeds; only seeds that pass the filter, if given."""
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch):
                words = Words(data, offsets, lower=True)
                hashes, row, place = _seeds(words, masks, lengths, phrase, beyond)
                if wanted is not None:
                    passed = in_filter(wanted.value, hashes)
                    hashes, row, place = hashes[passed], row[passed], place[passed]
                order = np.lexsort((place, row))
                hashes, place = hashes[order], place[order]
                counts = np.bincount(row, minlength=len(offsets) - 1)
                rows = np.flatnonzero(counts)
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(first + rows)),
                            pa.array([words.hash[words.first[r] : words.first[r + 1]].tobytes() for r in rows], pa.binary()),
                            _hit_struct(hashes, place, counts[rows]),
                        ],
                        ["id", "words", "hits"],
                    )

    return frame.mapInArrow(run, f"id {kind}, words binary, hits {_HITS}")


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, share: float) -> tuple[int, int, int]:
    """Of doc[shift + j] against item[j], the stretch of items words [start, end) with the most equal words
    among those whose share of equal words is at least ``share``; and that number of equal words."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    equal = doc[low + shift : high + shift] == item[low:high]
    count = np.concatenate([[0], np.cumsum(equal)])
    surplus = count - share * np.arange(len(count)) + 1e-9 * np.arange(len(count))
    least = np.minimum.accumulate(surplus)
    start = np.searchsorted(-least, -surplus, side="left")
    matched = count - count[start]
    end = int(np.argmax(matched))
    begin = int(start[end])
    return low + begin, low + end, int(matched[end])


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_matches: int = MIN_MATCHES,
    min_share: float = MIN_SHARE,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Passages that documents share with benchmark items, up to replaced words: doc_id, item_id, doc_start,
    doc_end, item_start, item_end (words, ends exclusive) and n_matched.

    Both sides' windows are hashed under the masks. The benchmark's hashes fill a bit array of fixed size, which
    lets each task drop nearly all hashes of documents; what is left joins the benchmark's hashes
    as a table of any size. Each alignment that a hit proposes is verified word by word: the overlap
    counts if at least ``min_matches`` words agree (``min_share`` of an item's words, if that is fewer) and they are at
    least ``min_share`` of it; of several longest such stretches of an alignment the first is given. An item shorter than the
    masks has the hash of all its words instead, and all must agree; one of fewer than ``PHRASE`` words is found only as a
    whole document. Texts may be of any length; other columns, whatever their names, are left alone.

    Words are compared with A-Z lowered. Null or empty texts and empty tables give no row. Repeated rows each give their own rows; an item that two ids share gives rows for both.
    """
    spark = docs.sparkSession
    prepare(spark)
    span = min(map(len, masks))
    items = pin(_seed_rows(_table(benchmark, item_column, item_text_column), masks, range(1, span), span))
    sizes = items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(F.col("n") < span).distinct()
    lengths = sorted(r.n for r in sizes.collect())
    item_seeds = items.select(F.col("id").alias("item_id"), F.inline("hits")).withColumnRenamed("pos", "item_pos").distinct()
    wanted = spark.sparkContext.broadcast(bit_filter(item_seeds, filter_bits))
    found = _seed_rows(_table(docs, id_column, text_column), masks, lengths, PHRASE, BEYOND, wanted)
    found = pin(found.withColumn("row", F.monotonically_increasing_id()))
    hits = found.select("row", F.inline("hits"))
    aligned = hits.join(item_seeds, "hash").select("row", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
    pairs = aligned.distinct()
    item_words = items.select(F.col("id").alias("item_id"), F.col("words").alias("item_words")).distinct()
    candidates = pairs.join(item_words, "item_id").join(found.select("row", F.col("id").alias("doc_id"), "words"), "row")
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            shifts, ours, theirs = (batch.column(i) for i in (2, 3, 4))
            for i in range(batch.num_rows):
                doc = np.frombuffer(ours[i].as_buffer(), np.uint64)
                item = np.frombuffer(theirs[i].as_buffer(), np.uint64)
                shift = shifts[i].as_py()
                start, end, matched = best_overlap(doc, item, shift, min_share)
                if matched >= (len(item) if len(item) < span else min(min_matches, math.ceil(min_share * len(item) - 1e-9))):
                    kept.append(i)
                    rows.append((start + shift, end + shift, start, end, matched))
            if kept:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), *columns], names)

    names = ["doc_id", "item_id", "doc_start", "doc_end", "item_start", "item_end", "n_matched"]
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, " + ", ".join(f"{n} bigint" for n in names[2:])
    return candidates.select("doc_id", "item_id", "shift", "words", "item_words").mapInArrow(verify, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents without any that share a passage with the benchmark; rows with a null id stay unless found."""
    hit = overlaps(docs, benchmark, id_column, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs[id_column].eqNullSafe(hit["_hit"]), "left_anti")

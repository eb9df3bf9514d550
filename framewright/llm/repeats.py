"""Removal of repeated word windows, with a count-min sketch before the exact grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.components import prepare
from framewright.llm.countmin import cells_for, may_repeat, merged, partition_sketches, text_bytes
from framewright.llm.text import Words, mix, text_slices, whole_windows, window_hash

#: Words of a window.
WIDTH = 50
#: Windows a task gathers before it combines them and sends them on.
GATHER = 1 << 20
#: Parts that the rows of one id are dealt into by a hash of their text; each has a list of repeated windows of its own.
PARTS = 1 << 15
_SECOND_BASE = 0xA24BAED4963EE407


def _second(words: Words, width: int) -> np.ndarray:
    """32 further bits of each window, from other word values and another base."""
    return (window_hash(mix(words.hash + np.uint64(0x5851F42D4C957F2D)), width, _SECOND_BASE) >> np.uint64(32)).view(np.int64)


def anchors(words: Words, width: int) -> np.ndarray:
    """Per window the least hash of the grams of a third of its length within it.

    Equal windows have equal anchors, and most neighbours share theirs, so a document has far fewer
    different anchors than windows: counting these overestimates no window's count downwards.
    """
    gram = max(1, width // 3)
    least = window_hash(words.hash, gram, 0x8CB92BA72F3D8DD7)
    span, reach = width - gram + 1, 1
    if len(least) < span:
        return np.zeros(0, np.uint64)
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _distinct_per_text(words: Words, ok: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The anchors of each text, each once."""
    rows, values = words.row[: len(ok)][ok], values[ok]
    if not len(values):
        return values
    new = np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])]
    rows, values = rows[new], values[new]
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    return values[np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])]]


def counted_anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """What the sketch counts of some texts: the anchors of each, each once."""
    words = Words(data, offsets)
    return _distinct_per_text(words, whole_windows(words, width), anchors(words, width))


def _combine(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Gathered windows, each once per part of a document; of those that several documents here share, all but the
    smallest document's are known to be repeated and only that one's has still to meet other tasks'."""
    order = np.lexsort((part, doc, h2, h1))
    h1, h2, doc, part = h1[order], h2[order], doc[order], part[order]
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    other = new | np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]
    h1, h2, doc, part, new = h1[other], h2[other], doc[other], part[other], new[other]
    known = doc > doc[new][np.cumsum(new) - 1]
    columns = [pa.array(h1.view(np.int64)), pa.array(h2.astype(np.int64)), pa.array(doc), pa.array(part, pa.int16()), pa.array(known)]
    return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc", "part", "known"])


def _window_rows(docs: DataFrame, width: int, sketch) -> DataFrame:
    """The windows of (doc_id, text, part) that the sketch lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            ids, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for first, data, offsets in text_slices(batch):
                words = Words(data, offsets)
                ok = whole_windows(words, width)
                if not ok.any():
                    continue
                passed = np.flatnonzero(ok)
                passed = passed[may_repeat(anchors(words, width)[passed], sketch.value)]
                row = first + words.row[passed]
                gathered.append((window_hash(words.hash, width)[passed], _second(words, width)[passed], ids[row], parts[row]))
                size += len(passed)
                if size >= GATHER:
                    yield _combine(*(np.concatenate(c) for c in zip(*gathered, strict=True)))
                    gathered, size = [], 0
        if size:
            yield _combine(*(np.concatenate(c) for c in zip(*gathered, strict=True)))

    return docs.mapInArrow(run, "h1 bigint, h2 bigint, doc bigint, part smallint, known boolean")


def _flagged(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The texts with the hashes of the repeated windows of their part of their document."""
    flags = repeated.groupBy(F.col("doc").alias("_doc"), F.col("part").alias("_part")).agg(F.collect_list("h1").alias("flags"))
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("part") == F.col("_part"))
    return docs.join(flags, same, "left").select("doc_id", "text", "flags")


def sketch_cells(texts: DataFrame, width: int) -> int:
    """Cells of a sketch line, a power of two that follows the size of all texts."""
    return cells_for(text_bytes(texts) / 6 * 2 / (width - width // 3 + 1))


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, cells: int | None = None
) -> DataFrame:
    """Per document doc_id, n_words, n_removed and ``kept``, its words that no repeated window covers, joined by spaces.

    A window of ``width`` words is repeated if the same words also start somewhere in a document with a smaller id.
    First every partition makes a count-min sketch of the windows of its documents and the sketches are merged;
    a window that occurs in two documents never has an estimate below two. Then only windows with such
    an estimate are grouped exactly, by 96 bits of hash. A task combines its own before the shuffle, so a passage
    that a third of all documents share sends one row a task.

    A null text has no words; ids are integers. A null id counts as larger than every other: such rows are documents of
    their own that lose what documents with an id hold, and take nothing from each other. Rows that share an id are one
    document to the windows and each gets its own row. A text of fewer than ``width`` words is kept whole; texts may be
    of any length, an empty table gives no rows, and other columns, whatever their names, are left alone.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    cells = cells or sketch_cells(texts, width)
    parts = partition_sketches(texts, lambda data, offsets: counted_anchors(data, offsets, width), cells)
    sketch = spark.sparkContext.broadcast(merged(parts, cells))
    named = texts.where("doc_id is not null").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("smallint"))
    rows = _window_rows(named, width, sketch)
    # Rows already known to be repeated pass the shuffle on a key of their own.
    same = Window.partitionBy("h1", "h2", F.when(F.col("known"), F.col("doc")))
    met = rows.withColumn("least", F.min("doc").over(same))
    repeated = met.where(F.col("known") | (F.col("doc") > F.col("least")))
    joined = _flagged(named, repeated)
    if not texts.where("doc_id is null").isEmpty():
        # without an id the hash of the text stands for it
        keyed = texts.where("doc_id is null").select(F.xxhash64("text").alias("doc_id"), "text", F.lit(0).cast("smallint").alias("part"))
        lost = _window_rows(keyed, width, sketch).join(rows.select("h1", "h2"), ["h1", "h2"], "left_semi")
        nameless = _flagged(keyed, lost).withColumn("doc_id", F.lit(None).cast("bigint"))
        joined = joined.unionByName(nameless)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flagged = batch.column(2)
            for first, data, offsets in text_slices(batch):
                raw, kept, counts, removed = data.tobytes(), [], [], []
                for i in range(len(offsets) - 1):
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    counts.append(len(words))
                    gone = 0
                    if flagged[first + i].is_valid and len(words) >= width:
                        own = Words(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                        hashes = flagged[first + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                        hit = np.isin(window_hash(own.hash, width), hashes)
                        step = np.zeros(len(words) + 1, np.int64)
                        step[:-width] += hit
                        step[width:] -= hit
                        covered = np.cumsum(step)[:-1] > 0
                        gone = int(covered.sum())
                        words = [words[j] for j in np.flatnonzero(~covered).tolist()]
                    removed.append(gone)
                    kept.append(b" ".join(words))
                ids = batch.column(0).slice(first, len(counts))
                columns = [ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept string")

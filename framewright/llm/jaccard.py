"""Grouped prefix join: documents whose shingle sets have a Jaccard similarity of at least a threshold."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.components import bit_filter, components, in_filter, prepare, stored
from framewright.llm.countmin import cells_for, may_repeat, merged, partition_sketches, text_bytes
from framewright.llm.text import Words, mix, text_slices, window_hash

#: Words of a shingle and the similarity of a link, in hundredths.
SHINGLE = 3
PERCENT = 90
#: Cells of the frequency table that orders shingles: one for so many shingles, and at most so many (one byte each
#: in its broadcast form). It decides only which shingles come first, never which documents link.
SHINGLES_PER_CELL = 128
MAX_CELLS = 1 << 24
BLOCK = 1 << 15
#: Cells of the sketch per prefix shingle. A fuller sketch than usual: a shingle it lets through costs one short row.
CELLS_PER_ITEM = 2
#: Bits of the filter of documents that have a candidate; a fuller one only lets more sets be stored.
FILTER_BITS = 1 << 25


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending by hash: (hashes, bounds of each text).

    A text of fewer words than a shingle has its whole sequence as one; without words it has none.
    """
    words = Words(data, offsets, lower=True)
    counts = np.diff(words.first)
    hashes = window_hash(words.hash, size)
    rows = words.row[: len(hashes)]
    ok = rows == words.row[size - 1 :] if len(hashes) else np.zeros(0, bool)
    hashes, rows = hashes[ok], rows[ok]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = []
        for r in short:
            total = int(counts[r])
            for h in words.hash[words.first[r] : words.first[r + 1]].tolist():
                total = (total * 0x9E3779B97F4A7C15 + h) % 2**64
            whole.append(total)
        hashes, rows = np.concatenate([hashes, np.array(whole, np.uint64)]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    if len(hashes):
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]
        hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def _frequencies(texts: DataFrame, size: int, cells: int) -> np.ndarray:
    """Per cell a byte that grows with the logarithm of how many documents' shingles fall into it, over all documents."""
    block = min(BLOCK, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            for _, data, offsets in text_slices(batch):
                at, n = np.unique(shingle_sets(data, offsets, size)[0] & np.uint64(cells - 1), return_counts=True)
                total[at] += n.astype(np.uint32)
        parts = total.reshape(-1, block)
        used = np.flatnonzero(parts.any(axis=1))
        payloads = [zlib.compress(parts[i].tobytes(), 1) for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(payloads, pa.binary())], ["block", "part"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(block, np.uint64)
        for part in group.column(1):
            total += np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
        scale = np.rint(4 * np.log2(total.astype(float) + 1)).astype(np.uint8)
        return pa.table({"block": group.column(0).slice(0, 1), "scale": pa.array([scale.tobytes()], pa.binary())})

    parts = texts.select("text").mapInArrow(count, "block bigint, part binary")
    found = parts.groupBy("block").applyInArrow(merge, "block bigint, scale binary").toArrow()
    out = np.zeros(cells, np.uint8)
    for at, scale in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[at * block : (at + 1) * block] = np.frombuffer(scale, np.uint8)
    return out


def frequency_cells(size: int) -> int:
    return 1 << min(max(int(size / 6 / SHINGLES_PER_CELL), 1 << 12).bit_length(), MAX_CELLS.bit_length() - 1)


def _ranked(data: np.ndarray, offsets: np.ndarray, size: int, percent: int, scale: np.ndarray):
    """The sets of some texts and their prefixes: (hashes, bounds, prefix shingles, their positions, prefix lengths)."""
    hashes, bounds = shingle_sets(data, offsets, size)
    n = np.diff(bounds)
    rows = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, scale[hashes & np.uint64(len(scale) - 1)], rows))
    rank = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
    length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
    first = rank < np.repeat(length, n)
    return hashes, bounds, hashes[order][first], rank[first], length


def _prefixes(texts: DataFrame, size: int, percent: int, frequencies, sketch) -> DataFrame:
    """Per row doc_id, the size of its set, 128 bits of the whole set, 64 bits of its prefix, and of the prefix what
    another document may have, with positions.

    The prefix is the rarest shingles, so many that two documents which link have one in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch):
                hashes, bounds, prefix, at, length = _ranked(data, offsets, size, percent, frequencies.value)
                n, ends = np.diff(bounds), np.concatenate([[0], np.cumsum(length)])
                columns = [batch.column(0).slice(first, len(n)), pa.array(n.astype(np.int64))]
                for values, cuts in (
                    (mix(hashes), bounds),
                    (mix(hashes ^ np.uint64(0x6C62272E07BB0142)), bounds),
                    (mix(prefix ^ np.uint64(0x27D4EB2F165667C5)), ends),
                ):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
                    columns.append(pa.array((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64)))
                kept = may_repeat(prefix, sketch.value)
                starts = np.concatenate([[0], np.cumsum(kept)])[ends].astype(np.int32)
                pairs = [pa.array(at[kept].astype(np.int64)), pa.array(prefix[kept].view(np.int64))]
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(pairs, ["pos", "token"]))
                yield pa.RecordBatch.from_arrays([*columns, lists], ["doc_id", "n", "s1", "s2", "p", "prefix"])

    schema = "doc_id bigint, n bigint, s1 bigint, s2 bigint, p bigint, prefix array<struct<pos: bigint, token: bigint>>"
    return texts.mapInArrow(run, schema)


def _sets(texts: DataFrame, size: int, wanted) -> DataFrame:
    """The sets of the documents that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64))
            some = batch.filter(pa.array(in_filter(wanted.value, keys)))
            for first, data, offsets in text_slices(some):
                hashes, bounds = shingle_sets(data, offsets, size)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(0).slice(first, len(lists)), lists], ["doc_id", "shingles"])

    return texts.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _mixed(ids: DataFrame, column: str) -> DataFrame:
    """The column ``hash`` by which _sets looks ids up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values)], ["hash"])

    return ids.select(column).mapInArrow(run, "hash bigint")


def _may_link(a: str, b: str, percent: int):
    """Whether two sets of sizes ``{a}n`` and ``{b}n`` whose first common prefix shingle stands at ``{a}pos`` and
    ``{b}pos`` can still be similar enough: by their sizes, and by what is left from there on."""
    an, bn, ap, bp = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    least = F.least(an - ap, bn - bp)
    return (F.least(an, bn) * 100 >= F.greatest(an, bn) * percent) & (least * (100 + percent) >= (an + bn) * percent)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that link, by their sets. Only documents of a pair are cut into shingles again."""
    either = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    wanted = texts.sparkSession.sparkContext.broadcast(bit_filter(_mixed(either, "id"), FILTER_BITS))
    sets = _sets(texts, size, wanted)
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent).select("a", "b")


def jaccard_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    cells: int | None = None,
) -> DataFrame:
    """Per document doc_id, n_shingles and component_id, the smallest doc_id that links reach (itself included).

    Documents link if the Jaccard similarity of their shingle sets is at least ``percent`` hundredths.

    1. Equal sets are one document, the one with the smallest id. Shingles are ordered by how many
       documents have them, rarest first; the first few of each set, its prefix, hold one that any similar set has too.
    2. Documents with equal prefixes and sizes are one group. Groups that share a prefix shingle are candidates if sizes
       and positions allow a link. Of each shingle's list the group that it stands first in is the centre;
       each group is verified against the centre that most of its shingles name, each member against its group's first.
       That is linear in the lists, and joins what belongs together.
    3. Groups are expanded. Only pairs of one shingle's list that are not yet in one component are left: those outside
       the list's most frequent component, against all. They are verified one by one, so no link between components is lost.

    A null text has no shingles; such documents, empty ones and rows with a null id (whose component is null) link
    with nothing. Rows that share an id are one vertex. Ids are integers; other columns are left out.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    octets = text_bytes(texts)
    frequencies = spark.sparkContext.broadcast(_frequencies(texts, size, cells or frequency_cells(octets)))
    ranked = lambda data, offsets: _ranked(data, offsets, size, percent, frequencies.value)[2]
    lines = cells_for(octets / 6 * (1 - percent / 100) * 1.2, CELLS_PER_ITEM)
    sketch = spark.sparkContext.broadcast(merged(partition_sketches(texts, ranked, lines), lines))
    base = stored(_prefixes(texts, size, percent, frequencies, sketch), "prefixes")

    distinct = base.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2", "p")
    ones = stored(distinct.agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix")), "distinct")
    groups = ones.groupBy("n", "p").agg(F.min("rep").alias("g"), F.first("prefix").alias("prefix"))
    members = ones.select("n", "p", "rep").join(groups.select("n", "p", "g"), ["n", "p"])
    postings = groups.select("g", "n", F.inline("prefix"))
    centres = postings.groupBy("token").agg(
        F.count("*").alias("many"), F.min(F.struct("pos", "g", "n")).alias("c")
    ).where("many > 1")
    # Only shingles that two groups share are kept.
    shared = stored(
        postings.join(centres, "token").select("token", "g", "n", "pos", *(F.col(f"c.{x}").alias(f"c_{x}") for x in ("g", "n", "pos"))),
        "postings",
    )
    named = shared.where(F.col("g") != F.col("c_g")).where(_may_link("", "c_", percent))
    votes = named.groupBy("g", "c_g").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("g").agg(F.max(F.struct("votes", "c_g")).alias("v"))
    stars = chosen.select(F.col("g").alias("a"), F.col("v.c_g").alias("b"))
    inner = members.where("rep != g").select(F.col("rep").alias("a"), F.col("g").alias("b"))
    first = stored(_verified(stored(stars.union(inner), "pairs"), texts, size, percent), "links")
    known = stored(components(first), "components")

    listed = shared.select("token", "g", "n", "pos").join(members.select("g", "rep"), "g")
    # The members of a group have a list of their own, for they need not share a shingle with another group.
    own = inner.select(F.col("b").alias("g")).distinct().join(members, "g")
    own = own.select(F.xxhash64("n", "p").alias("token"), "rep", "n", F.lit(0).cast("bigint").alias("pos"))
    listed = listed.select("token", "rep", "n", "pos").union(own).join(known, F.col("rep") == F.col("vertex"), "left")
    listed = listed.select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("k"))
    per = listed.groupBy("token", "k").agg(F.count("*").alias("c"))
    major = per.groupBy("token").agg(F.count("*").alias("kinds"), F.max(F.struct("c", "k")).alias("m")).where("kinds > 1")
    open_ = listed.join(major.select("token", F.col("m.k").alias("m_k")), "token")
    x = open_.where("k != m_k").select("token", *(F.col(c).alias(f"x_{c}") for c in ("rep", "n", "pos", "k")))
    y = open_.select("token", *(F.col(c).alias(f"y_{c}") for c in ("rep", "n", "pos", "k")), (F.col("k") == F.col("m_k")).alias("y_major"))
    once = F.col("y_major") | (F.col("x_rep") < F.col("y_rep"))
    met = x.join(y, "token").where(F.col("x_k") != F.col("y_k")).where(once).where(_may_link("x_", "y_", percent))
    rest = met.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()
    links = first.union(_verified(stored(rest, "pairs"), texts, size, percent))
    reached = components(links)

    least = ones.select("n", "s1", "s2", "rep").join(reached, F.col("rep") == F.col("vertex"), "left")
    least = least.select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    linked = base.join(least, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))

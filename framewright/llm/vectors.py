"""Near-duplicate vectors: blocks of clustered vectors, compared two by two where they are stored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from framewright.llm.components import components, prepare, stored

COSINE = 0.9
#: Vectors of a chunk, the unit that is compared or skipped, and the most cells the space is cut into: their centres go to every task.
CHUNK = 1024
MAX_CELLS = 4096
#: Bytes of vectors of a block, which a task reads whole, at most and (but for the last) at least; a table has about BLOCKS of them between these.
BLOCK_BYTES = 16 << 20
LEAST_BYTES = 1 << 20
BLOCKS = 20
#: The cell of vectors of a length that no centre was drawn of.
ALONE = -1
#: Rows and columns of a tile that is compared at once, and the share of candidates from which a tile is multiplied whole.
TILE = 512, 1024
DENSE = 0.01
#: Edges that a task keeps of two blocks, besides one for each vector.
EDGES = 1 << 20


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    """A fixed random rotation, which spreads the variance evenly over the dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def head(size: int, cosine: float) -> int:
    """How many of the rotated dimensions tell most unrelated vectors apart; all, if that saves little.

    By the cube root of a chi-squared: of vectors that point anywhere, some two in 10,000 are that near in so many.
    """
    need = size * (1 - cosine)
    for h in range(8, size, 4):
        if h * max(0.0, 1 - 2 / (9 * h) - 3.5 * (2 / (9 * h)) ** 0.5) ** 3 >= need:
            return h if 2 * h <= size else size
    return size


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    vectors = vectors.astype(float)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class Side:
    """Unit vectors of one length as the comparison needs them: the rows in both precisions, and their heads.

    A head has the first rotated dimensions and the length of what is left, so the product of two heads is never
    below the cosine.
    """

    def __init__(self, ones: np.ndarray, cosine: float):
        self.ones, self.single = ones, ones.astype(np.float32)
        size = ones.shape[1]
        #: A bound on what single precision adds to or takes from a product of two rows.
        self.slack = 1e-7 * (size + 16)
        h = head(size, cosine)
        self.head = self.single
        if h < size:
            turned = ones @ rotation(size)[:, :h]
            rest = np.sqrt(np.maximum(1 - (turned * turned).sum(axis=1), 0))
            self.head = np.column_stack([turned, rest]).astype(np.float32)


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero() of a mask that has few; it looks at 64 places at once, then at eight."""
    flat, eight = mask.ravel(), np.arange(8)
    whole = flat.size & ~63
    words = flat[:whole].view(np.uint64)
    at = (np.flatnonzero((words != 0).view(np.uint64))[:, None] * 8 + eight).ravel()
    at = (at[words[at] != 0][:, None] * 8 + eight).ravel()
    at = np.concatenate([at, np.arange(whole, flat.size)])
    return np.divmod(at[flat[at]], mask.shape[1])


def tile(x: Side, y: Side, rows: slice, columns: slice, cosine: float) -> tuple[np.ndarray, np.ndarray] | np.ndarray | None:
    """The pairs of a tile with a cosine of at least ``cosine``: their places, or in a dense tile a mask; None if there are none.

    Single precision decides where its error cannot matter, double precision otherwise.
    """
    sure, maybe = np.float32(cosine + x.slack), np.float32(cosine - x.slack)
    near = x.head[rows] @ y.head[columns].T >= maybe
    many = np.count_nonzero(near)
    if not many:
        return None
    if many <= DENSE * near.size:
        i, j = places(near)
        keep = verified(x, y, i + rows.start, j + columns.start, cosine)
        return (i[keep], j[keep]) if keep.any() else None
    cosines = x.single[rows] @ y.single[columns].T
    near = cosines >= sure
    i, j = places((cosines >= maybe) & ~near)
    near[i, j] = verified(x, y, i + rows.start, j + columns.start, cosine)
    many = np.count_nonzero(near)
    if many > DENSE * near.size:
        return near
    return places(near) if many else None


def verified(x: Side, y: Side, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    found = [np.einsum("ij,ij->i", x.ones[i[s : s + 16384]], y.ones[j[s : s + 16384]]) >= cosine for s in range(0, len(i), 16384)]
    return np.concatenate(found or [np.zeros(0, bool)])


def links(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of unit vectors whose cosine is at least ``cosine``."""
    found = tile(Side(a, cosine), Side(b, cosine), slice(0, len(a)), slice(0, len(b)), cosine)
    if found is None:
        return np.zeros(0, int), np.zeros(0, int)
    return np.nonzero(found) if isinstance(found, np.ndarray) else found


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per vertex 0..n-1 the least vertex of its component under the edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanned(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and per column of a mask the least row that its edges reach; columns without an edge have the number of rows."""
    none, label = np.int32(len(near)), np.arange(len(near), dtype=np.int32)
    while True:
        below = np.where(near, label[:, None], none).min(axis=0)
        new = np.minimum(label, np.where(near, below[None, :], none).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label, below
        label = new


class Block:
    """The vectors of a block by their length, with the chunks of each."""

    def __init__(self, sizes: list[int], counts: list[int], reps: bytes, weights: bytes, vectors: bytes, kind: str, cosine: float):
        self.reps, self.weights = np.frombuffer(reps, np.int64), np.frombuffer(weights, np.int64).astype(float)
        parts: dict[int, list[int]] = {}
        for size, count in zip(sizes, counts, strict=True):
            parts.setdefault(size, []).append(count)
        raw, row, at = np.frombuffer(vectors, kind), 0, 0
        #: By length: its first row, its vectors, where its chunks end, their centres and their radii.
        self.of: dict[int, tuple[int, Side, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, many in parts.items():
            ends = np.concatenate([[0], np.cumsum(many)])
            ones = unit(raw[at : at + ends[-1] * size].reshape(-1, size))
            centres = np.array([ones[s:e].mean(axis=0) for s, e in zip(ends, ends[1:], strict=False)])
            radii = np.array([np.sqrt(((ones[s:e] - c) ** 2).sum(axis=1)).max() for s, e, c in zip(ends, ends[1:], centres, strict=False)])
            self.of[size] = row, Side(ones, cosine), ends, centres, radii
            row, at = row + ends[-1], at + ends[-1] * size


def _runs(where: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """The rows of the chunks ``where``, neighbours together up to a tile's columns."""
    start = stop = -1
    for k in where.tolist():
        if start >= 0 and ends[k] == stop and ends[k + 1] - start <= TILE[1]:
            stop = int(ends[k + 1])
            continue
        if start >= 0:
            yield slice(start, stop)
        start, stop = int(ends[k]), int(ends[k + 1])
    if start >= 0:
        yield slice(start, stop)


def compared(left: Block, right: Block, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, n, near) of the vectors of two blocks, or of one with itself, that link: n sums the weights that a
    vector links to, and near is a vector of its component among these links."""
    own = left is right
    ids, shift = (left.reps, 0) if own else (np.concatenate([left.reps, right.reps]), len(left.reps))
    n, edges, reach = np.zeros(len(ids)), [], np.sqrt(2 - 2 * cosine) + 1e-6
    for size in left.of.keys() & right.of.keys():
        (p, x, a_ends, a_centres, a_radii), (q, y, b_ends, b_centres, b_radii) = left.of[size], right.of[size]
        for k in range(len(a_radii)):
            gap = np.sqrt(((b_centres - a_centres[k]) ** 2).sum(axis=1))
            joined = gap <= a_radii[k] + b_radii + reach
            if own:
                joined[:k] = False
            first, last = int(a_ends[k]), int(a_ends[k + 1])
            tops = [slice(r, min(r + TILE[0], last)) for r in range(first, last, TILE[0])]
            for rows, columns in product(tops, [*_runs(np.flatnonzero(joined), b_ends)]):
                found = tile(x, y, rows, columns, cosine)
                if found is None:
                    continue
                i0, j0 = p + rows.start, q + columns.start
                if isinstance(found, tuple):
                    i, j = found[0] + i0, found[1] + j0
                    if own:
                        i, j = i[i < j], j[i < j]
                    np.add.at(n, i, right.weights[j])
                    np.add.at(n, j + shift, left.weights[i])
                else:
                    if own:
                        found &= np.arange(i0, i0 + found.shape[0])[:, None] < np.arange(j0, j0 + found.shape[1])[None, :]
                    n[i0 : i0 + found.shape[0]] += found @ right.weights[j0 : j0 + found.shape[1]]
                    n[shift + j0 : shift + j0 + found.shape[1]] += left.weights[i0 : i0 + found.shape[0]] @ found
                    label, below = spanned(found)
                    j = np.flatnonzero(below < len(label))
                    moved = np.flatnonzero(label != np.arange(len(label)))
                    edges.append((moved + i0, label[moved] + i0))
                    i, j = below[j] + i0, j + j0
                edges.append((i, j + shift))
                if sum(len(i) for i, _ in edges) > EDGES + len(ids):
                    label = least_reached(len(ids), *(np.concatenate(e) for e in zip(*edges, strict=True)))
                    moved = np.flatnonzero(label != np.arange(len(ids)))
                    edges = [(moved, label[moved])]
    hit = np.flatnonzero(n)
    if not len(hit):
        return ids[:0], ids[:0], ids[:0]
    label = least_reached(len(ids), *(np.concatenate(e) for e in zip(*edges, strict=True)))
    return ids[hit], n[hit].astype(np.int64), ids[label[hit]]


def _cell(vectors: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
    if centres is None:
        return np.full(len(vectors), ALONE)
    return np.argmax(unit(vectors) @ centres.T, axis=1)


def _of_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of the vectors of a column, the rows that have it and their vectors."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        same = column if len(at) == len(sizes) else column.take(pa.array(at))
        yield int(size), at, same.flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def _blocks_of(sample: DataFrame, cells: int, distinct: int, width: int):
    """Where the vectors go: per length the centres of its cells, and per length and cell its first block and over
    how many it is dealt. Blocks are filled by the sample's counts, ``distinct`` vectors being in the table."""
    drawn = sample.where(F.col("place") < cells).select("embedding").toArrow().column(0).combine_chunks()
    centres = {size: unit(np.unique(vectors, axis=0)) for size, _, vectors in _of_length(drawn)} if len(drawn) else {}
    shared = sample.sparkSession.sparkContext.broadcast(centres)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, vectors in _of_length(batch.column(0)):
                cell, many = np.unique(_cell(vectors, shared.value.get(size)), return_counts=True)
                columns = [np.full(len(cell), size), cell, many]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["size", "cell", "many"])

    counts = sample.select("embedding").mapInArrow(count, "size bigint, cell bigint, many bigint")
    found = sorted(tuple(r) for r in counts.groupBy("size", "cell").agg(F.sum("many")).collect())
    drawn_share = max(sum(r[2] for r in found), 1) / max(distinct, 1)
    sizes = [(size, cell, many / drawn_share * size * width) for size, cell, many in found]
    most = min(BLOCK_BYTES, max(LEAST_BYTES, sum(s for *_, s in sizes) / BLOCKS))
    places: dict[tuple[int, int], tuple[int, int]] = {}
    block, filled = 0, 0.0
    for size, cell, held in sizes:
        if filled and filled + held > most:
            block, filled = block + 1, 0.0
        parts = max(int(np.ceil(held / most)), 1)
        places[size, cell] = block, parts
        if parts > 1:
            block, filled = block + parts, 0.0
        else:
            filled += held
    return shared, sample.sparkSession.sparkContext.broadcast((places, block + bool(filled) or 1))


def _placed(rows: DataFrame, centres, places) -> DataFrame:
    """The rows (vec_id, h1, h2, weight, embedding) with their block and cell; of equal vectors of a batch only one is kept, with all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, blocks = places.value
        for batch in batches:
            batch = batch.take(pa.array(np.unique(_keys(batch, ("h1", "h2", "vec_id")), return_index=True)[1]))
            if not batch.num_rows:
                continue
            keys = _keys(batch, ("h1", "h2"))
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            h2 = batch.column(2).to_numpy().view(np.uint64)
            column, block, cells = batch.column(4), np.empty(len(keys), np.int32), np.empty(len(keys), np.int32)
            for size, at, vectors in _of_length(column):
                cell = _cell(vectors, centres.value.get(size))
                to = [where.get((size, int(c)), (size % blocks, 1)) for c in np.unique(cell)]
                to = np.array(to)[np.unique(cell, return_inverse=True)[1]]
                block[at] = to[:, 0] + (h2[at] % to[:, 1].astype(np.uint64)).astype(np.int64)
                cells[at] = cell
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())]) * values.itemsize
            valid = pa.py_buffer(np.packbits(first, bitorder="little").tobytes())
            vectors = pa.Array.from_buffers(pa.binary(), len(keys), [valid, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(cells), *batch.columns[:4], vectors], ["block", "cell", "vec_id", "h1", "h2", "weight", "vector"]
            )

    return rows.select("vec_id", "h1", "h2", "weight", "embedding").mapInArrow(
        run, "block int, cell int, vec_id bigint, h1 bigint, h2 bigint, weight bigint, vector binary"
    )


def _keys(table: pa.RecordBatch | pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Columns of whole numbers as one array of records, which sorts by them in turn."""
    out = np.empty(table.num_rows, [(name, np.int64) for name in names])
    for name in names:
        out[name] = table.column(name).to_numpy()
    return out


def _packed(placed: DataFrame, width: int) -> DataFrame:
    """One row for each block: its vectors, each once, by length and cell, with the least id and the number of ids of each."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys = _keys(group, ("h1", "h2", "vec_id"))
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate([[True], (keys["h1"][1:] != keys["h1"][:-1]) | (keys["h2"][1:] != keys["h2"][:-1])])
        starts = np.flatnonzero(new)
        other = new | np.concatenate([[True], keys["vec_id"][1:] != keys["vec_id"][:-1]])
        weights = np.add.reduceat(other.astype(np.int64), starts)
        given = group.column("weight").to_numpy(zero_copy_only=False).astype(float)[order][starts]
        weights = np.where(np.isnan(given), weights, np.nan_to_num(given)).astype(np.int64)
        there = group.column("vector").is_valid().to_numpy(zero_copy_only=False)[order]
        held = np.minimum.reduceat(np.where(there, np.arange(len(there)), len(there)), starts)
        vectors = group.column("vector").take(pa.array(order[held]))
        sizes = pc.binary_length(vectors).to_numpy(zero_copy_only=False) // width
        cells = group.column("cell").to_numpy()[order[held]]
        by = np.lexsort((cells, sizes))
        sizes, cells, vectors = sizes[by], cells[by], vectors.take(pa.array(by))
        cut = np.flatnonzero(np.concatenate([[True], (sizes[1:] != sizes[:-1]) | (cells[1:] != cells[:-1])]))
        ends = [min(s + CHUNK, e) for a, e in zip(cut, [*cut[1:], len(by)], strict=True) for s in range(a, e, CHUNK)]
        begins = np.array([0, *ends[:-1]])
        joined = b"".join(vectors.to_pylist())
        return pa.table(
            {
                "block": pa.array([group.column("block")[0].as_py()], pa.int32()),
                "sizes": pa.array([sizes[begins].tolist()], pa.list_(pa.int32())),
                "counts": pa.array([(np.array(ends) - begins).tolist()], pa.list_(pa.int32())),
                "reps": pa.array([keys["vec_id"][starts][by].tobytes()], pa.binary()),
                "weights": pa.array([weights[by].tobytes()], pa.binary()),
                "vectors": pa.array([joined], pa.binary()),
            }
        )

    return placed.groupBy("block").applyInArrow(
        pack, "block int, sizes array<int>, counts array<int>, reps binary, weights binary, vectors binary"
    )


def _met(blocks: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(rep, n, near) of each two blocks that meet, see compared(). A product of the stored blocks: each task reads
    its blocks from there, and nothing is shuffled or sent to the driver."""
    names = blocks.columns
    left, right = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in names)) for side in ("x", "y"))
    pairs = left.join(right, F.col("x_block") <= F.col("y_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Block] = {}

        def block(batch: pa.RecordBatch, row: int, at: int, other: int | None = None) -> Block:
            name = batch.column(at)[row].as_py()
            if name not in held:
                for old in [k for k in held if k != other]:
                    del held[old]
                sizes, counts = (batch.column(at + k)[row].as_py() for k in (1, 2))
                held[name] = Block(sizes, counts, *(batch.column(at + k)[row].as_buffer() for k in (3, 4, 5)), kind, cosine)
            return held[name]

        for batch in batches:
            for row in range(batch.num_rows):
                x = block(batch, row, 0, batch.column(len(names))[row].as_py())
                y = block(batch, row, len(names), batch.column(0)[row].as_py())
                columns = compared(x, y, cosine)
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "n", "near"])

    return pairs.mapInArrow(run, "rep bigint, n bigint, near bigint")


def _sound(vector: Column) -> Column:
    """Whether a vector has no null or non-finite part and some part that is not zero."""
    most, least, inf = F.array_max(vector), F.array_min(vector), F.lit(float("inf"))
    whole = ~F.array_contains(vector, float("nan"))  # null if there is a null
    return F.coalesce(whole & (most < inf) & (least > -inf) & ((most > 0) | (least < 0)), F.lit(False))


def near_vectors(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """Per vector vec_id, n_links, component_id and kept.

    Two vectors of the same length link if their cosine, in double precision, is at least ``cosine``. n_links
    counts the other vectors that link; component_id is the smallest id that links reach; kept marks it.

    1. Equal vectors, told by 128 bits of hashes, are one with a weight, so a vector that a third of all rows repeat
       is compared once. Of a vector with more than its part of the rows only those of its least id move.
    2. The space is cut into at most MAX_CELLS cells around vectors drawn by their hash; vectors of a length that no
       drawn one has are a cell of their own. Cells are dealt to blocks of BLOCK_BYTES at most and come there in
       chunks of up to CHUNK vectors. Vectors move once, and the blocks are stored once.
    3. Every two blocks meet in one task, which reads both from where they are stored. Chunks meet unless their
       centres and radii part them. The vectors are rotated; what the first dimensions and the length of the rest
       leave possible is a candidate and verified exactly. A task returns counts and one edge a vector, never the
       pairs of a group.

    Vectors that are null, zero or hold null or non-finite parts, and rows with a null id (whose
    component is null), link with nothing. Rows that share an id are one vertex; links count different vectors. An empty
    table gives no rows; other columns, whatever their names, are left alone.
    """
    spark = rows.sparkSession
    prepare(spark)
    element = getattr(rows.select(rows[vector_column].alias("v")).schema["v"].dataType, "elementType", None)
    name, kind = ("float", "f4") if isinstance(element, FloatType) else ("double", "f8")
    width = int(kind[1])
    named = rows.select(rows[id_column].cast("bigint").alias("vec_id"), rows[vector_column].cast(f"array<{name}>").alias("embedding"))
    good = F.col("vec_id").isNotNull() & _sound(F.col("embedding"))
    #: Rows that link with nothing have no second hash and, not to meet in one task, any first one.
    hashed = named.select(
        "vec_id",
        "embedding",
        F.when(good, F.xxhash64("embedding")).otherwise(F.xxhash64("vec_id")).alias("h1"),
        F.when(good, F.xxhash64(F.lit(1), "embedding")).alias("h2"),
    )
    valid = hashed.where("h2 is not null")
    copies = valid.groupBy("h1", "h2", "vec_id").agg(F.count("*").alias("times"))
    copies = copies.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.sum("times").alias("times"))
    ones = stored(copies, "vectors")

    distinct, total = ones.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    cells = min(max((distinct + CHUNK - 1) // CHUNK, 1), MAX_CELLS)
    place = F.pmod("h1", F.lit(max(distinct, 1)))
    sample = valid.withColumn("place", place).where(F.col("place") < max(16 * cells, 4096))
    sample = stored(sample.dropDuplicates(["h1", "h2"]).select("place", "embedding"), "sample")
    centres, places = _blocks_of(sample, cells, distinct, width)

    often = ones.where(F.col("times") > max(total // MAX_CELLS, CHUNK)).select("h1", "h2", "rep", "weight")
    moved = valid.join(F.broadcast(often), ["h1", "h2"], "left").where("rep is null or rep = vec_id")
    blocks = stored(_packed(_placed(moved, centres, places), width), "blocks", maxRecordsPerFile=1)
    met = stored(_met(blocks, kind, cosine), "links")
    direct = met.groupBy("rep").agg(F.sum("n").alias("n"))
    reached = components(met.select(F.col("rep").alias("a"), F.col("near").alias("b")))

    vectors = ones.select("h1", "h2", "rep", "weight").join(direct, "rep", "left")
    vectors = vectors.join(reached, F.col("rep") == F.col("vertex"), "left")
    vectors = vectors.select(
        "h1",
        "h2",
        (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"),
        F.coalesce("component", "rep").alias("c"),
    )
    out = hashed.select("vec_id", "h1", "h2").join(vectors, ["h1", "h2"], "left")
    real = F.col("vec_id").isNotNull()
    component = F.when(real, F.coalesce("c", "vec_id"))
    return out.select(
        "vec_id",
        F.when(real, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )

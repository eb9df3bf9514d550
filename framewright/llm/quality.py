"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.components import prepare, stored
from framewright.llm.text import _SPACE, Words, mix, text_slices

#: Labelled rows the classifiers are fitted on, at most; which ones is decided by a hash of their ids.
LABELLED_ROWS = 20_000
ROUNDS = 3
#: A view passes on a guess from this confidence.
CONFIDENCE = 0.95
#: Of five labelled rows, the part that calibrates and is never fitted on.
FOLDS = 5
#: Documents that score below are rejected.
THRESHOLD = 0.5
#: Buckets that hashed metadata values fall into.
BUCKETS = 32
#: Buckets that hashed words, and pairs of words, of a text fall into.
WORD_BUCKETS = 64
#: Ridge of these buckets, in multiples of that of the other features: single words need more rows to speak.
WORD_RIDGE = 300.0

_CLASS = np.zeros(256, np.uint8)  # of bytes: letters and others 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]\\=+_"]] = 3
_CLASS[[ord(c) for c in "|"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-/"]] = 6
_CLASS[_SPACE] = 7
_CLASS[10] = 8
_CLASS[128:] = 9
_KINDS = 10


def _share(rows: np.ndarray, hit: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(rows[hit], minlength=n) / np.maximum(of, 1)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text its length, its shares of kinds of characters, how often its words and word pairs repeat, and the
    square roots of the shares of its lower-cased words and word pairs by bucket."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    sizes, counts = np.diff(offsets), np.diff(words.first)
    kinds = np.stack([np.add.reduceat(np.append(_CLASS[data] == k, False).astype(np.int64), offsets[:-1]) for k in range(1, _KINDS)], axis=1)
    kinds[sizes == 0] = 0
    shares = kinds / np.maximum(sizes, 1)[:, None]
    same = np.zeros(len(words), bool)
    if len(words) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    order = np.lexsort((words.hash, words.row))
    new = np.ones(len(words), bool)
    if len(words) > 1:
        h, r = words.hash[order], words.row[order]
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    short = words.end - words.start == 1
    repeated = [_share(words.row, same, n, counts), _share(words.row[order], ~new, n, counts), _share(words.row, short, n, counts)]
    lengths = [np.log1p(sizes), np.log1p(counts), np.log1p(sizes / np.maximum(counts, 1))]
    columns = np.column_stack([shares, *repeated])
    lowered = Words(data, offsets, lower=True).hash
    pairs = lowered[1:] * np.uint64(0x9E3779B97F4A7C15) + lowered[:-1]
    place = words.row * WORD_BUCKETS
    half = np.uint64(WORD_BUCKETS // 2)
    hashed = [place + (mix(lowered) % half).astype(np.int64), (place[1:] + WORD_BUCKETS // 2 + (mix(pairs) % half).astype(np.int64))[words.row[1:] == words.row[:-1]]]
    grams = np.bincount(np.concatenate(hashed), minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS) / np.maximum(counts, 1)[:, None]
    return np.column_stack([np.ones(n), columns, np.sqrt(columns), *lengths, np.sqrt(grams)])


def meta_features(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Per row one bucket a metadata value, hashed with its column's name; numbers by their order of magnitude."""
    out = np.zeros((batch.num_rows, 1 + BUCKETS))
    out[:, 0] = 1
    for name in columns:
        for i, value in enumerate(batch.column(batch.schema.get_field_index(name)).to_pylist()):
            if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value:
                value = f"1e{np.log10(1 + min(abs(value), 1e300)):.0f}"
            text = f"{name}={value}".encode()
            h = 0xCBF29CE484222325
            for byte in text:
                h = (h ^ byte) * 0x100000001B3 % 2**64
            out[i, 1 + (h >> 32) % BUCKETS] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


#: The sum over all rows of the pool of what a function makes of both views' features.
Total = Callable[[Callable[[list[np.ndarray]], np.ndarray]], np.ndarray | None]
#: The ridge of each view: one for all of its features, or one a feature.
Ridges = Sequence[float | np.ndarray]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method with a ridge on all but the constant."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        size = np.abs(step).max()
        w -= step / max(1.0, size / 5)
        if size < 1e-6:
            break
    return w


@dataclass
class View:
    """One view's classifier: scaling, weights, and the line that calibrates its log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    line: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(((x - self.mean) / self.scale) @ self.weights, -30, 30)
        return self.line[0] + self.line[1] * raw


@dataclass
class Model:
    """Two calibrated views; their log-odds add up, the share of good documents counted once."""

    text: View | None
    meta: View | None
    prior: float
    columns: list[str]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            p = np.full(len(text), self.prior)
            return p, p, p
        a, b = self.text.odds(text), self.meta.odds(meta)
        start = np.log(self.prior / (1 - self.prior))
        return sigmoid(a), sigmoid(b), sigmoid(a + b - start)


def _taught(x: list[np.ndarray], teachers: list[View]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each view the rows that the other one is sure of, and its guesses."""
    for k in range(len(x)):
        p = sigmoid(teachers[1 - k].odds(x[1 - k]))
        sure = (p >= CONFIDENCE) | (p <= 1 - CONFIDENCE)
        yield x[k][sure], (p[sure] >= 0.5).astype(float)


def _moments(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Number of rows, then sums and sums of squares about ``shift``."""
    away = x - shift
    return np.concatenate([[len(x)], away.sum(axis=0), (away**2).sum(axis=0)])


def _slope(x: np.ndarray, y: np.ndarray, view: View) -> np.ndarray:
    """Gradient and curvature of the logistic loss, and the loss."""
    scaled = (x - view.mean) / view.scale
    odds = scaled @ view.weights
    p = sigmoid(odds)
    curve = (scaled * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ scaled
    return np.concatenate([scaled.T @ (p - y), curve.ravel(), [(np.logaddexp(0, odds) - y * odds).sum()]])


def _each(x: list[np.ndarray], teachers: list[View], f: Callable, given: list) -> np.ndarray:
    return np.concatenate([f(own, y, at) for (own, y), at in zip(_taught(x, teachers), given, strict=True)])


def fit_views(
    views: list[np.ndarray], labels: np.ndarray, held: np.ndarray, teachers: list[View] | None, total: Total, ridges: Ridges = (1.0, 1.0), steps: int = 50
) -> list[View] | None:
    """Both views fitted by Newton's method, with a ridge each on all but the constant, on the labelled rows and, with
    ``teachers``, on every row of the pool that the other view is sure of. None if there is no such row."""
    own, y = [x[~held] for x in views], labels[~held]

    def summed(f: Callable, given: list) -> list[np.ndarray]:
        """Per view the sums of f over its rows."""
        parts = [f(x, y, at) for x, at in zip(own, given, strict=True)]
        ends = np.cumsum([len(p) for p in parts])[:-1]
        more = total(lambda x: _each(x, teachers, f, given)) if teachers else None
        return parts if more is None else [p + m for p, m in zip(parts, np.split(more, ends), strict=True)]

    shifts = [x.mean(axis=0) for x in own]
    fitted = []
    for k, found in enumerate(sums := summed(lambda x, _, at: _moments(x, at), shifts)):
        n, (first, second) = found[0], np.split(found[1:], 2)
        mean, scale = shifts[k] + first / n, np.sqrt(np.maximum(second / n - (first / n) ** 2, 0))
        mean[0], scale[0] = 0, 1
        scale[scale < 1e-9] = 1
        fitted.append(View(mean, scale, np.zeros(len(mean)), np.array([0.0, 1.0])))
    if teachers and all(found[0] == len(y) for found in sums):
        return None
    best: list[tuple[float, np.ndarray, np.ndarray]] = [(np.inf, v.weights, v.weights) for v in fitted]  # loss, weights, step from there
    for _ in range(steps):
        for k, (view, found) in enumerate(zip(fitted, summed(_slope, fitted), strict=True)):
            d = len(view.weights)
            penalty = np.full(d, ridges[k]) if np.isscalar(ridges[k]) else np.array(ridges[k])
            penalty[0] = 1e-6
            loss = found[-1] + 0.5 * penalty @ view.weights**2
            if loss > best[k][0] * (1 + 1e-9):  # too far
                best[k] = (best[k][0], best[k][1], best[k][2] / 2)
            else:
                curve = found[d:-1].reshape(d, d) + np.diag(penalty)
                step = np.linalg.solve(curve, found[:d] + penalty * view.weights)
                best[k] = (loss, view.weights, step / max(1.0, np.abs(step).max() / 5))
            view.weights = best[k][1] - best[k][2]
        if max(np.abs(step).max() for _, _, step in best) < 1e-6:
            break
    for view, x in zip(fitted, views, strict=True):
        raw = view.odds(x[held])
        view.line = fit_logistic(np.column_stack([np.ones(len(raw)), raw]), labels[held], ridge=1e-3)
    return fitted


def co_train(
    views: list[np.ndarray], labels: np.ndarray, held: np.ndarray, pools: list[np.ndarray] | Total, rounds: int = ROUNDS, ridges: Ridges = (1.0, 1.0)
) -> list[View]:
    """Fit both views on labelled rows, then let each label every pool row it is sure of for the other.

    The pool is given by both views' features or by sums over it.
    """
    total = pools if callable(pools) else lambda f: f(pools)
    fitted = fit_views(views, labels, held, None, total, ridges)
    for _ in range(rounds):
        more = fit_views(views, labels, held, fitted, total, ridges)
        if more is None:
            break
        fitted = more
    return fitted


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed_over(pool: DataFrame) -> Total:
    """Sums over the rows of (tx, mx), added up by partition in a fixed order.

    With many partitions groups of them are added up first, so that what the driver gets stays small.
    """

    n = pool.rdd.getNumPartitions()
    groups = n if n <= 256 else int(n**0.5)

    def total(f: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                if batch.num_rows:
                    part = f([_matrix(batch.column(0)), _matrix(batch.column(1))])
                    found = part if found is None else found + part
            if found is not None:
                at = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.asarray(found, float)])], ["part", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sorted((at, sums) for b in batches for at, sums in zip(*(c.to_pylist() for c in b.columns), strict=True))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([np.sum([x for _, x in rows], axis=0)])], ["part", "sums"])

        sums = pool.mapInArrow(run, "part int, sums array<double>")
        if groups < n:
            sums = sums.repartition(groups, F.col("part") % groups).mapInArrow(add, sums.schema)
        rows = sums.toArrow().sort_by("part").column("sums").to_pylist()
        return np.sum(rows, axis=0) if rows else None

    return total


def _featured(docs: DataFrame, columns: list[str], model=None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of (key, text, metadata) with both views' features, or with their scores if there is a model."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch):
                part = batch.slice(first, len(offsets) - 1)
                text, meta = text_features(data, offsets), meta_features(part, columns)
                if model is None:
                    lists = [pa.array(list(text)), pa.array(list(meta))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["key", "tx", "mx"])
                else:
                    a, b, p = model.value.scores(text, meta)
                    out = [part.column(0), *map(pa.array, (a, b, p)), pa.array(p >= threshold)]
                    yield pa.RecordBatch.from_arrays(out, ["key", "p_text", "p_meta", "score", "accepted"])

    rest = "tx array<double>, mx array<double>" if model is None else "p_text double, p_meta double, score double, accepted boolean"
    return docs.select("key", "text", *columns).mapInArrow(run, f"key {kind}, {rest}")


def _named(docs: DataFrame, id_column: str, text_column: str, meta_columns: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"m_{c}" for c in meta_columns]
    picked = [docs[c].alias(n) for c, n in zip(meta_columns, names, strict=True)]
    return docs.select(docs[id_column].cast("bigint").alias("key"), docs[text_column].cast("string").alias("text"), *picked), names


def train(
    docs: DataFrame,
    labels: DataFrame,
    meta_columns: list[str],
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    labelled_rows: int = LABELLED_ROWS,
    rounds: int = ROUNDS,
) -> Model:
    """The model of labelled documents (label 1 good, 0 bad), a bounded sample by hash, and of all unlabelled ones.

    Both views' features are computed once and stored; each round takes some passes over those of the unlabelled rows.
    Of labelled rows that share an id one counts, whatever the order of the rows; others and rows without an id count each. An id with several labels has their rounded mean; null labels and ids are left out. With only one class, or too
    few rows to hold some back, the model scores every document with the share of good ones (1 without labels).
    """
    prepare(docs.sparkSession)
    named, names = _named(docs, id_column, text_column, meta_columns)
    given = labels.where(labels[label_column].isNotNull() & labels[id_column].isNotNull())
    given = given.groupBy(given[id_column].cast("bigint").alias("key")).agg(F.round(F.avg(label_column)).cast("int").alias("y"))
    # A null id meets no label; its features spread such rows over the tasks of the join.
    found = _featured(named, names).withColumn("at", F.coalesce("key", F.xxhash64("tx", "mx")))
    given = given.withColumnRenamed("key", "labelled")
    found = found.join(given, (found["at"] == given["labelled"]) & found["key"].isNotNull(), "left")
    found = stored(found.select("key", "y", "tx", "mx"), "quality")
    order = [F.xxhash64("key"), F.col("key")]
    # Of rows that share an id the one with the least hash of its features, so that the model depends on the rows alone.
    one = F.min_by(F.struct("y", "tx", "mx"), F.struct(F.xxhash64("tx", "mx"), "tx", "mx")).alias("one")
    chosen = found.where("y is not null").groupBy("key").agg(one).select("key", "one.*").orderBy(*order).limit(labelled_rows)
    rows = chosen.toArrow().sort_by("key")
    if not rows.num_rows:
        return Model(None, None, 1.0, names)
    good = rows.column("y").to_numpy(zero_copy_only=False).astype(float)
    views = [np.array(rows.column(c).to_pylist(), float).reshape(len(good), -1) for c in ("tx", "mx")]
    held = np.zeros(len(good), bool)
    for value in (0, 1):
        held[np.flatnonzero(good == value)[::FOLDS]] = True
    prior = float(np.clip((good.sum() + 1) / (len(good) + 1), 0, 1))
    if any(len(set(part.tolist())) < 2 for part in (good[held], good[~held])):
        return Model(None, None, prior, names)
    words = np.arange(views[0].shape[1]) >= views[0].shape[1] - WORD_BUCKETS
    pool = summed_over(found.where("y is null").select("tx", "mx"))
    fitted = co_train(views, good, held, pool, rounds, (np.where(words, WORD_RIDGE, 1.0), 1.0))
    return Model(fitted[0], fitted[1], float(np.clip(good.mean(), 1e-3, 1 - 1e-3)), names)


def quality_scores(
    docs: DataFrame, model: Model, meta_columns: list[str], id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Per document its id, p_text and p_meta (each view's calibrated probability of being good), score (both
    together) and accepted (score of at least ``threshold``).

    A null text counts as empty and a null metadata value as a value of its own; such rows are scored like any other.
    Whole texts are read, row by row; repeated rows each get theirs.
    """
    prepare(docs.sparkSession)
    named, names = _named(docs, id_column, text_column, meta_columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _featured(named, names, shared, threshold).withColumnRenamed("key", id_column)


def accepted_documents(docs: DataFrame, model: Model, meta_columns: list[str], text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that ``quality_scores`` accepts, all columns as they are, in one pass without a shuffle."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in meta_columns}
            for first, data, offsets in text_slices(batch, text_column):
                part = batch.slice(first, len(offsets) - 1)
                meta = pa.RecordBatch.from_arrays([part.column(at[n]) for n in meta_columns], [f"m_{n}" for n in meta_columns])
                _, _, score = shared.value.scores(text_features(data, offsets), meta_features(meta, shared.value.columns))
                yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)

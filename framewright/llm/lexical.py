"""Ranked lexical search: the best documents of each of many queries, term at a time with a limit on accumulators.

Queries are taken in blocks of a bounded number. For each block one pass over the documents makes an index of the
block's terms, in blocks of documents; what weights need (documents, words, document frequencies) is summed from
that index. A second pass ranks each block of documents alone and keeps, per task and query, the ``k`` best so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.components import prepare, stored
from framewright.llm.text import text_slices
from framewright.llm.tokens import lower_runs

#: A term is a run of ASCII letters and digits and of everything beyond ASCII.
_TERM = np.ones(256, bool)
_TERM[:128] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _TERM[_a:_b] = True

#: Queries that are ranked together, and documents of an index block, at most. Both bound memory and change no result.
BLOCK_QUERIES = 2_000
BLOCK_DOCS = 4_096


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The terms of some texts in order, A to Z lower-cased, and of each the number of its text."""
    start, _, terms = lower_runs(data, offsets, _TERM[data])
    return np.searchsorted(offsets, start, side="right") - 1, terms


def query_terms(queries: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item, term) without repeats; rows of one id are one query."""
    kind = queries.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch):
                row, terms = terms_of(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), terms], ["item", "term"])

    source = queries.select(F.col(id_column).alias("item"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, f"item {kind}, term binary").distinct()


_INDEX = "docs array<{kind}>, words array<bigint>, term array<int>, doc array<int>, tf array<bigint>, held array<int>, df array<bigint>"


def _index(docs: DataFrame, terms: list[bytes], block_docs: int) -> DataFrame:
    """Blocks of documents: their ids and numbers of terms; postings of ``terms`` by term and document; document
    frequencies. Documents without a term of any kind are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.binary())
        ids, words, postings, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([p for p, _ in postings])
            counts = np.concatenate([c for _, c in postings])
            order = np.argsort(keys, kind="stable")
            term, doc, tf = keys[order] >> 32, keys[order] & 0xFFFFFFFF, counts[order]
            held, df = np.unique(term, return_counts=True)
            columns = [
                pa.concat_arrays(ids), pa.array(np.concatenate(words)), pa.array(term.astype(np.int32)), pa.array(doc.astype(np.int32)),
                pa.array(tf), pa.array(held.astype(np.int32)), pa.array(df),
            ]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            return pa.RecordBatch.from_arrays(lists, ["docs", "words", "term", "doc", "tf", "held", "df"])

        for batch in batches:
            for first, data, offsets in text_slices(batch):
                row, found = terms_of(data, offsets)
                n = np.bincount(row, minlength=len(offsets) - 1)
                own = np.flatnonzero(n)
                number = np.cumsum(n > 0) - 1 + size
                code = pc.index_in(found, known).fill_null(-1).to_numpy()
                hit = code >= 0
                keys, counts = np.unique((code[hit].astype(np.int64) << 32) | number[row[hit]], return_counts=True)
                ids.append(batch.column(0).take(pa.array(own + first)))
                words.append(n[own].astype(np.int64))
                postings.append((keys, counts.astype(np.int64)))
                size += len(own)
                if size >= block_docs:
                    yield flush()
                    ids, words, postings, size = [], [], [], 0
        if size:
            yield flush()

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, _INDEX.format(kind=kind))


class Best:
    """The ``k`` best documents of a query so far: scores, and ids that decide between equal ones, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple[int, bool, int]] = []

    def bar(self) -> int:
        """What a further document must reach to be looked at; an equal score may still win by its id."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 0

    def add(self, scores: np.ndarray, ids: list) -> None:
        found = [(-s, i is None, i if i is not None else 0) for s, i in zip(scores.tolist(), ids, strict=True)]
        self.rows = sorted(self.rows + found)[: self.k]


def accumulate(postings: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, bar: int) -> np.ndarray:
    """Scores of a block's documents, term at a time.

    ``postings`` are documents and positive or zero contributions of each term, rarest term first. ``bar`` is the score of
    the kth document known from elsewhere. A document gets an accumulator, a score above zero, from the first term that
    adds to it. Once all the terms left together cannot bring a new document to the kth partial score, none gets one any
    more; those that have one are updated by every term that is left. So the scores of all that can be among the k
    best are exact, and others are zero.
    """
    total = np.zeros(size, np.int64)
    bounds = [int(c.max()) if len(c) else 0 for _, c in postings]
    left = sum(bounds)
    opening = True
    for (docs, adds), bound in zip(postings, bounds, strict=True):
        if opening:
            alive = np.count_nonzero(total)
            kth = max(bar, int(np.partition(total, size - k)[size - k]) if alive >= k else 0)
            opening = left >= kth
        if opening:
            total[docs] += adds
        else:
            seen = total[docs] > 0
            total[docs[seen]] += adds[seen]
        left -= bound
    return total


def term_weights(n_docs: int, df: list[int]) -> list[int]:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df]


def _rank(index: DataFrame, queries: list[tuple[object, list[int]]], item_type: str, weights: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """The k best of each query in the blocks that a task reads."""
    kind = index.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        id_kind = None
        for batch in batches:
            for i in range(batch.num_rows):
                docs, words, term, doc, tf = (batch.column(c)[i].values for c in ("docs", "words", "term", "doc", "tf"))
                id_kind = docs.type
                term, doc, tf = (c.to_numpy(zero_copy_only=False) for c in (term, doc, tf))
                m = 10 + (90 * words.to_numpy(zero_copy_only=False) * n_docs) // n_words
                adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                new = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
                ends = np.r_[new[1:], len(term)][: len(new)]
                lists = {int(t): (doc[a:b], adds[a:b]) for t, a, b in zip(term[new].tolist(), new.tolist(), ends.tolist(), strict=True)}
                for own, (_, terms) in zip(best, queries, strict=True):
                    bar = own.bar()
                    scores = accumulate([lists[t] for t in terms if t in lists], len(docs), min(k, len(docs)), bar)
                    at = np.flatnonzero(scores >= max(bar, 1))
                    if len(at) > k:
                        least = np.partition(scores[at], len(at) - k)[len(at) - k]
                        at = at[scores[at] >= least]
                    if len(at):
                        own.add(scores[at], docs.take(pa.array(at)).to_pylist())
        rows = [(item, None if void else d, -s) for own, (item, _) in zip(best, queries, strict=True) for s, void, d in own.rows]
        if rows:
            items, ids, scores = zip(*rows, strict=True)
            columns = [pa.array(items, item_kind), pa.array(ids, id_kind), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    item_kind = pa.array([q[0] for q in queries]).type
    return index.mapInArrow(run, f"item_id {item_type}, doc_id {kind}, score bigint")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, block_queries: int = BLOCK_QUERIES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The ``k`` best documents of each query: item_id, rank (from 1), doc_id, score.

    ``docs`` has ``doc_id`` and ``text``, ``queries`` has ``item_id`` and ``text``; other columns are left alone. A null
    text has no terms. Documents with at least one term count in N, their terms in L; a term counts once a query. Scores are
    whole numbers: the sum over the query's terms of weight * ((10^9 tf) div (1000 tf + 8 m)) with m = 10 + ((90 n N) div L). Only
    scores above 0 rank; equal ones by ascending doc_id, null last. Rows of one document id are documents of their own, rows of one
    item_id (null among them) are one query. An empty table of either kind gives no rows. A text may be of any length
    below 2 GB.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks = max(1, -(-queries.select("item_id").distinct().count() // block_queries))
    asked = stored(query_terms(queries), "queries")
    item_type = asked.schema["item"].dataType.simpleString()
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().to_pydict()
        names = sorted(set(own["term"]))
        if not names:
            continue
        index = stored(_index(docs, names, block_docs), "index")
        n_docs, n_words = index.agg(F.sum(F.size("docs")), F.sum(F.aggregate("words", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
        if not n_docs:
            continue
        held = index.select(F.explode(F.arrays_zip("held", "df")).alias("x")).groupBy("x.held").agg(F.sum("x.df").alias("df"))
        df = np.zeros(len(names), np.int64)
        for row in held.collect():
            df[row["held"]] = row["df"]
        place = {name: i for i, name in enumerate(names)}
        items: dict = {}
        for item, term in zip(own["item"], own["term"], strict=True):
            if df[place[term]]:
                items.setdefault(item, []).append(place[term])
        ranked = [(item, sorted(terms, key=lambda t: (df[t], t))) for item, terms in items.items()]
        if not ranked:
            continue
        found = _rank(index, ranked, item_type, np.array(term_weights(n_docs, df.tolist()), np.int64), n_docs, n_words, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {kind}, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

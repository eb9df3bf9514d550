"""Phrases whose words occur together more often than apart, from sorted streams of phrase counts.

Words are counted as phrases of three, those at the end of a piece with fewer, so each word of the corpus begins
exactly one of them. Ranges of these, sorted, are one stream in *prefix order*: a phrase's first words stand
directly before it, and their counts are sums over the run that shares them. From the stream of all frequent phrases
(one, two and three words) two lockstep passes take what a score needs: in prefix order the counts of the first
words, in *suffix order* (last word first) those of the last words. Rows are dealt out by ranges of the order, never
by a hash, and no pass holds more than a batch.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.components import prepare, stored
from framewright.llm.text import text_slices
from framewright.llm.tokens import binary_array, lower_runs

#: What parts words, and what ends a piece of text besides.
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text whose phrases a task counts before it hands them on. It bounds memory and changes no result.
CHUNK_BYTES = 16 << 20
#: Phrases drawn for each range of an order; they only deal rows out evenly.
DRAWS = 64
#: Rows of a sorted stream that are worked on at once.
STREAM_ROWS = 1 << 16

#: A word in a key ends with a tab, which no word holds, so keys that share words stand together in byte order.
_END = b"\t"


def piece_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of some texts, and of each whether the next one follows in the same piece."""
    stop = _STOP[data]
    start, end, words = lower_runs(data, offsets, ~(stop | _GAP[data]))
    joined = np.zeros(len(start), bool)
    if len(start) > 1:
        stops = np.cumsum(stop, dtype=np.int32)
        row = np.searchsorted(offsets, start, side="right")
        joined[:-1] = (stops[start[1:]] == stops[end[:-1] - 1]) & (row[1:] == row[:-1])
    return words, joined


class Phrases:
    """Counts of the phrases of three words that begin at each word of some texts of one language."""

    def __init__(self, words: list[pa.Array], joined: list[np.ndarray]):
        coded = pa.chunked_array([*(w.dictionary_encode() for w in words), pa.array([b""], pa.binary()).dictionary_encode()]).unify_dictionaries()
        names = coded.chunk(0).dictionary
        keys = pc.binary_join_element_wise(names, pa.scalar(b""), pa.scalar(_END))
        order = pc.sort_indices(keys).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys, self.size = keys.take(pa.array(order)), len(order)
        codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        first, end = rank[codes[:-1]], rank[codes[-1]]
        next_ = np.concatenate(joined)
        second, third = np.full_like(first, end), np.full_like(first, end)
        second[:-1][next_[:-1]] = first[1:][next_[:-1]]
        both = next_[:-2] & next_[1:-1]
        third[:-2][both] = first[2:][both]
        pairs, at = np.unique(first * self.size + second, return_inverse=True)
        grams, self.n = np.unique(at * self.size + third, return_counts=True)
        pair = pairs[grams // self.size]
        self.first, self.second, self.third = pair // self.size, pair % self.size, grams % self.size

    def __len__(self) -> int:
        return len(self.n)

    def cut(self, bounds: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
        """How many phrases come before each bound."""
        names = self.keys.to_pylist() if bounds else []
        out = []
        for bound in bounds:
            low, high = 0, len(self)
            for column, word in zip((self.first, self.second, self.third), bound, strict=True):
                i = bisect.bisect_left(names, word)
                same = i < len(names) and names[i] == word
                part = column[low:high]
                low, high = low + int(np.searchsorted(part, i)), low + int(np.searchsorted(part, i, side="right" if same else "left"))
                if low == high:
                    break
            out.append(low)
        return np.array(out, np.int64)

    def text(self, start: int, end: int) -> pa.Array:
        words = [self.keys.take(pa.array(c[start:end])) for c in (self.first, self.second, self.third)]
        return pc.binary_join_element_wise(*words, pa.scalar(b"")).cast(pa.string())


def _key(key: str) -> tuple[bytes, bytes, bytes]:
    a, b, c = key.encode().split(_END)[:3]
    return a + _END, b + _END, c + _END


def _language_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, int]]:
    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            for _, data, offsets in text_slices(batch.filter(pc.equal(langs, lang))):
                words, joined = piece_words(data, offsets)
                if len(words):
                    yield lang, words, joined, len(data)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")


def _drawn_bounds(keys: DataFrame, parts: int) -> list[tuple[str, str]]:
    """Up to ``parts - 1`` (lang, key) that cut some drawn keys into equal parts; the driver gets a fixed number a part."""
    drawn = sorted({(r.lang, r.key) for r in keys.limit(16 * DRAWS * parts).collect()})
    return sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []


def phrase_bounds(docs: DataFrame, parts: int) -> list[tuple[str, str]]:
    """Bounds of ranges of phrases, from some phrases of some texts drawn at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(1)
        for lang, words, joined, _ in _language_slices(batches):
            found = Phrases([words], [joined])
            at = random.integers(0, len(found), len(found) // 128 + 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), found.text(0, len(found)).take(pa.array(at))], ["lang", "key"])

    share = min(1.0, DRAWS * parts / max(docs.count(), 1))
    return _drawn_bounds(_texts(docs).sample(share, 1).mapInArrow(run, "lang string, key string"), parts)


def _counted(texts: DataFrame, bounds: list[tuple[str, str]], chunk_bytes: int) -> DataFrame:
    """(part, lang, key, n): the phrases of three of each chunk of text, in the order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                found = Phrases(*held.pop(lang))
                base = bisect.bisect_left(bounds, (lang, ""))
                own = [_key(k) for name, k in bounds[base:] if name == lang]
                part = base + np.searchsorted(found.cut(own), np.arange(len(found)), side="right")
                for i in range(0, len(found), STREAM_ROWS):
                    j = min(i + STREAM_ROWS, len(found))
                    columns = [pa.array(part[i:j], pa.int32()), pa.array([lang]).take(pa.array(np.zeros(j - i, np.int64))), found.text(i, j), pa.array(found.n[i:j], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "lang", "key", "n"])

        for lang, words, joined, n in _language_slices(batches):
            own = held.setdefault(lang, ([], []))
            own[0].append(words)
            own[1].append(joined)
            size += n
            if size >= chunk_bytes:
                yield from flush()
                size = 0
        yield from flush()

    return texts.mapInArrow(run, "part int, lang string, key string, n bigint")


class _Runs:
    """Sums over runs of equal first words of a sorted stream, across batches.

    The first and the last run of a range may go on in a neighbouring one: they leave whatever their sum, marked open.
    """

    def __init__(self, level: int, least: int):
        self.level, self.least = level, least
        self.label: str | None = None
        self.total, self.opens = 0, True

    def feed(self, new: np.ndarray, n: np.ndarray, keys: pa.Array, out: list) -> None:
        start = np.flatnonzero(new)
        self.total += int(n[: start[0] if len(start) else len(n)].sum())
        if not len(start):
            return
        self._leave(out)
        sums, begin = np.add.reduceat(n, start), 0
        if self.opens and len(sums) > 1:
            self.label, self.total, begin = keys[int(start[0])].as_py(), int(sums[0]), 1
            self._leave(out)
        at = begin + np.flatnonzero(sums[begin:-1] >= self.least)
        for key, total in zip(keys.take(pa.array(start[at])).to_pylist(), sums[at].tolist(), strict=True):
            self._emit(out, key, total, False)
        self.label, self.total = keys[int(start[-1])].as_py(), int(sums[-1])

    def _leave(self, out: list, last: bool = False) -> None:
        if self.label is not None:
            opened = (self.opens or last) and self.level < 3
            if opened or self.total >= self.least:
                self._emit(out, self.label, self.total, opened)
            self.opens = False

    def _emit(self, out: list, key: str, total: int, opened: bool) -> None:
        words = key.split("\t")[: self.level]
        if self.level and not words[-1]:
            return  # nothing follows: no phrase of this length
        out.append((self.level, *words, *[""] * (3 - self.level), total, opened))


def _prefix_change(keys: pa.Array, lengths: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the first ``lengths`` bytes of a key differ from those of the key before; the first counts as different."""
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)) < np.repeat(lengths, np.diff(offsets))
    return _change(binary_array(lengths, data[inside]))


def _change(values: pa.Array) -> np.ndarray:
    new = np.ones(len(values), bool)
    new[1:] = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return new


_MERGED = "lang string, level int, w1 string, w2 string, w3 string, n bigint, opened boolean"


def _merged(sorted_parts: DataFrame, least: int) -> DataFrame:
    """Counts of words, pairs and phrases of three from sorted ranges; level 0 has the words of a language."""

    def rows(lang: str, out: list) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(out)), *(pa.array(c) for c in zip(*out, strict=True))]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], ["lang", "level", "w1", "w2", "w3", "n", "opened"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, levels, last = None, [], None
        for table in _gathered(batches):
            langs = _change(table.column(0))
            edges = [*np.flatnonzero(langs).tolist(), table.num_rows]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                out: list = []
                own = table.column(0)[i].as_py()
                if own != lang:
                    for level in levels:
                        level._leave(out, last=True)
                    if out:
                        yield rows(lang, out)
                    out, lang, levels, last = [], own, [_Runs(k, least) for k in range(4)], None
                keys, n = table.column(1).slice(i, j - i), table.column(2).slice(i, j - i).to_numpy()
                keys = pa.concat_arrays([keys])
                seen = pa.concat_arrays([pa.array([last if last is not None else ""], pa.string()), keys])
                _, buffer, data = seen.buffers()
                offsets = np.frombuffer(buffer, np.int32, len(seen) + 1)
                data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
                tabs = np.flatnonzero(data == 9)
                if last is None:  # a key without any word before the first
                    tabs = np.r_[[-1, -1, -1], tabs]
                tabs = tabs.reshape(-1, 3) + 1 - offsets[:-1, None]
                whole = np.zeros(len(n), bool)
                whole[0] = last is None
                changes = [whole] + [_prefix_change(seen, tabs[:, k], data, offsets)[1:] for k in range(3)]
                for level, new in zip(levels, changes, strict=True):
                    level.feed(new, n, keys, out)
                last = keys[len(keys) - 1].as_py()
                if out:
                    yield rows(lang, out)
        out = []
        for level in levels:
            level._leave(out, last=True)
        if out:
            yield rows(lang, out)

    return sorted_parts.mapInArrow(run, _MERGED)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a stream in batches of some size."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= STREAM_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def phrase_counts(docs: DataFrame, least: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, level, w1, w2, w3, n): every word, pair and phrase of three with at least ``least`` occurrences,
    absent words being empty; level 0 has the number of words of each language."""
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _counted(_texts(docs), phrase_bounds(docs, parts), chunk_bytes)
    ranges = counted.repartitionById(parts, F.col("part")).select("lang", "key", "n").sortWithinPartitions("lang", "key")
    merged = stored(_merged(ranges, least), "phrases")
    keys = ["lang", "level", "w1", "w2", "w3"]
    opened = merged.where("opened").groupBy(*keys).agg(F.sum("n").alias("n"))
    return merged.where("not opened").drop("opened").unionByName(opened).where((F.col("level") == 0) | (F.col("n") >= least))


def lockstep(grams: DataFrame, words: tuple[str, str, str], names: tuple[str, str]) -> DataFrame:
    """Give each row the counts of the phrases of its first one and first two words, in the order of ``words``.

    The stream is cut into ranges of that order. A word or pair whose run goes on in later ranges is sent to each of
    them too, so a range holds what its rows need, before them. ``grams`` must hold all words and pairs that its
    rows begin with.
    """
    spark = grams.sparkSession
    own = grams.columns
    key = F.concat(*(F.when(F.col(w) != "", F.concat(w, F.lit("\t"))).otherwise("") for w in words))
    keyed = grams.withColumn("key", key)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, 2 * DRAWS * parts / max(grams.count(), 1))
    bounds = [(lang.encode(), k.encode()) for lang, k in _drawn_bounds(keyed.select("lang", "key").sample(share, 1), parts)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys, levels = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "key", "level"))
            at, part = [], []
            for i, (lang, k, level) in enumerate(zip(langs, keys, levels, strict=True)):
                lang, k = lang.encode(), k.encode()
                first = last = bisect.bisect_right(bounds, (lang, k))
                while level < 3 and last < len(bounds) and bounds[last][0] == lang and bounds[last][1].startswith(k):
                    last += 1
                at += [i] * (last - first + 1)
                part += range(first, last + 1)
            at = np.array(at, np.int64)
            belongs = np.r_[True, at[1:] != at[:-1]][: len(at)]
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part, pa.int32()), pa.array(belongs)], [*taken.schema.names, "part", "belongs"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [0, 0]
        for batch in _gathered(batches):
            level, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("level", "n"))
            found = []
            for k in (0, 1):
                at = np.maximum.accumulate(np.where(level == k + 1, np.arange(len(n)), -1))
                counts = np.where(at >= 0, n[at], held[k])
                held[k] = int(counts[-1])
                found.append(pa.array(counts, pa.int64()))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, *found], [*own, *names]).filter(batch.column(batch.schema.get_field_index("belongs")))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grams.schema)
    dealt = keyed.mapInArrow(deal, f"{kinds}, key string, part int, belongs boolean")
    sent = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("lang", "key")
    return sent.mapInArrow(follow, f"{kinds}, {names[0]} bigint, {names[1]} bigint")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    wide = "CAST({} AS DECIMAL(15, 0))"
    a, left, right = (wide.format(c) for c in (a, left, right))
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {a} * {a}) div ({left} * {right})")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``top`` best phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: no words), other columns are left alone. A to Z are
    lower-cased; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. A candidate occurs a >= ``least``
    times. Cut into a first part that occurs l times and a rest that occurs r times it scores
    floor(1000000 a a / (l r)); its lowest cut counts, of equal ones the first. Pairs inside a candidate of three words
    that occurs at least ``share`` percent as often as they do are dropped. Equal scores rank by a, largest first,
    then by the phrase's bytes. Repeated rows count as often as they stand there, a text may be of any length, and an
    empty table has no phrases.
    """
    spark = docs.sparkSession
    counts = phrase_counts(docs, least, chunk_bytes)
    grams = counts.where("level > 0")
    forward = stored(lockstep(grams, ("w1", "w2", "w3"), ("l1", "l2")), "prefix-order")
    last = {"x1": "element_at(w, -1)", "x2": "coalesce(get(w, size(w) - 2), '')", "x3": "coalesce(get(w, size(w) - 3), '')"}
    turned = forward.withColumn("w", F.expr("filter(array(w1, w2, w3), x -> x <> '')"))
    turned = turned.select(*forward.columns, *(F.expr(e).alias(c) for c, e in last.items()))
    both = stored(lockstep(turned, ("x1", "x2", "x3"), ("r1", "r2")).where("level > 1").drop("x1", "x2", "x3"), "suffix-order")

    threes = both.where("level = 3")
    inside = threes.where(100 * F.col("n") >= share * F.col("l2")).select("lang", "w1", "w2").union(
        threes.where(100 * F.col("n") >= share * F.col("r2")).select("lang", "w2", "w3")
    )
    pairs = both.where("level = 2").join(inside.distinct().hint("merge"), ["lang", "w1", "w2"], "left_anti")
    one, two = _score("n", "l1", "r1"), _score("n", "l1", "r2")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("l1").alias("l"), F.col("r1").alias("r"), one.alias("score"))
    late = _score("n", "l2", "r1") < two
    threes = threes.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"),
        F.when(late, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(late, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least(_score("n", "l2", "r1"), two).alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = pairs.unionByName(threes).withColumn("_s", spread)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = counts.where("level = 0").select("lang", F.col("n").alias("words"))
    found = found.join(words, "lang").withColumn("rank", F.col("rank").cast("bigint"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")

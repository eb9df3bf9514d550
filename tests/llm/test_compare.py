"""Operators that compare documents or vectors with each other, against brute force."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from brute import Parts, corpus, frame, jaccard, lowered, repeats, sha, words

from framewright.llm import components as cc
from framewright.llm import countmin as cm
from framewright.llm import decontaminate as de
from framewright.llm import jaccard as ja
from framewright.llm import repeats as re_
from framewright.llm import vectors as ve
from framewright.llm.queries import all_queries
from framewright.llm.registry import read


def docs_of(spark, rows, parts=5):
    extra = [(i, t, "x", 1) for i, t in rows]
    return frame(spark, extra, "doc_id bigint, text string, a string, hash int").repartition(parts)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("cells", [None, 1 << 6])
def test_repeated_windows(spark, seed, cells):
    """Also with a sketch so full that it lets nearly everything through: nothing may be lost either way."""
    rows = corpus(seed)
    found = re_.remove_repeats(docs_of(spark, rows), width=8, cells=cells).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == repeats(rows, 8)


def test_sketch_never_underestimates(spark):
    rows = [(i, t) for i, t in corpus(3) if t]
    parts = cm.partition_sketches(frame(spark, rows).repartition(7), lambda d, o: re_.counted_anchors(d, o, 8), 1 << 12)
    sketch = cm.merged(parts, 1 << 12)
    seen = {}
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        w = re_.Words(data, np.array([0, len(data)]))
        for key, anchor in zip(zip(*(w.hash[k : len(w) - 7 + k].tolist() for k in range(8)), strict=True), re_.anchors(w, 8), strict=True):
            seen.setdefault(key, set()).add((i, int(anchor)))
    shared = {a for holders in seen.values() if len({i for i, _ in holders}) > 1 for _, a in holders}
    assert len(shared) > 50 and cm.may_repeat(np.array(list(shared), np.uint64), sketch).all()


def test_repeats_edges(spark):
    text = " ".join(f"w{i}" for i in range(9))
    rows = [(1, text), (1, text), (2, text + " z"), (None, text), (3, None), (4, ""), (5, " ".join(["du"] * 500)), (6, "du " * 40)]
    out = re_.remove_repeats(docs_of(spark, rows), width=8).collect()
    found = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed, r.kept) for r in out)
    assert [f[:3] for f in found] == [(1, 9, 0), (1, 9, 0), (2, 10, 9), (3, 0, 0), (4, 0, 0), (5, 500, 0), (6, 40, 40), (99, 9, 9)]
    assert found[2][3] == "z"
    assert re_.remove_repeats(frame(spark, [])).collect() == []


def test_many_rows_without_or_with_one_id(spark):
    """Rows without an id lose what named documents hold and nothing to each other; the largest id is an id like others."""
    passage, own = " ".join(f"p{i}" for i in range(12)), " ".join(f"o{i}" for i in range(10))
    last = (1 << 63) - 1
    rows = [(4, f"a {passage} b")] + [(None, f"x{i} {passage} {own}") for i in range(200)] + [(None, None), (None, ""), (None, own)]
    rows += [(9, f"y{i} {passage}") for i in range(200)] + [(last, f"{passage} {own} {own}")]
    found = re_.remove_repeats(docs_of(spark, rows), width=8).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed, r.kept) for r in found)
    expected = [(4, 0, f"a {passage} b"), (last, 12, f"{own} {own}"), (-1, 0, ""), (-1, 0, ""), (-1, 10, "")]
    expected += [(-1, 22, f"x{i}") for i in range(200)] + [(9, 12, f"y{i}") for i in range(200)]
    assert got == sorted(expected)


def test_registered_repeats(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    expected = {i: (n, g, sha(k)) for i, (n, g, k) in repeats(rows, 50).items()}
    found = all_queries()["op2_substring_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == expected


@pytest.mark.parametrize(("seed", "size", "percent"), [(4, 3, 90), (5, 3, 80), (6, 5, 80), (7, 1, 60)])
def test_jaccard_components(spark, seed, size, percent):
    rows = corpus(seed)
    found = ja.jaccard_components(docs_of(spark, rows), size=size, percent=percent).collect()
    expected = jaccard(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert sum(i != c for i, (_, c) in expected.items()) > 10


def test_large_group_of_near_copies(spark):
    """Copies around one text with so many changes that some pairs link and some do not."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(80)] = f"n{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    found = ja.jaccard_components(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == jaccard(rows, 3, 90)


@pytest.mark.parametrize("seed", range(3))
def test_links_within_a_group_of_equal_prefixes(spark, seed):
    """With a single cell all shingles count as equally frequent, so many near copies have the same prefix."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(base[: 40 - rng.randrange(8)] + [f"e{rng.randrange(3)}"] * rng.randrange(5))) for i in range(60)]
    found = ja.jaccard_components(docs_of(spark, rows), cells=1 << 12, size=1, percent=90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == jaccard(rows, 1, 90)


def test_jaccard_edges(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (2, "A B  C\nD"), (None, "a b c d"), (7, None), (8, ""), (9, "hi"), (10, "HI"), (11, "x y"), (12, "y x")]
    out = ja.jaccard_components(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert found == {3: (2, 2), 2: (2, 2), None: (2, None), 7: (0, 7), 8: (0, 8), 9: (1, 9), 10: (1, 9), 11: (1, 11), 12: (1, 12)}
    assert ja.jaccard_components(frame(spark, [])).collect() == []


def test_registered_jaccard(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    found = all_queries()["op5_ngram_jaccard"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == jaccard(rows, 3, 90)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (3, 2), (3, 2)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(edges)
    parts = Parts({v for e in edges for v in e})
    for a, b in edges:
        parts.join(a, b)
    found = cc.components(frame(spark, edges, "a bigint, b bigint").repartition(9)).collect()
    got = {r.vertex: r.component for r in found}
    assert len(found) == len(got)
    assert got == {v: parts.find(v) for v in parts.up if any(v in e and e[0] != e[1] for e in edges)}
    assert cc.components(frame(spark, [], "a bigint, b bigint")).collect() == []


def plain_vectors(rows):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    parts, n = Parts(dict(rows)), dict.fromkeys(dict(rows), 0)
    for a, b in itertools.combinations(good, 2):
        x, y = good[a], good[b]
        if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
            parts.join(a, b)
            n[a] += 1
            n[b] += 1
    return {i: (n[i], parts.find(i), parts.find(i) == i) for i in n}


@pytest.mark.parametrize("size", [5, 24, 64])
def test_near_vectors(spark, size, monkeypatch):
    monkeypatch.setattr(ve, "CHUNK", 40)
    rng = np.random.default_rng(size)
    base = rng.normal(size=(60, size))
    near = base[rng.integers(0, 60, 200)] + rng.normal(size=(200, size)) * rng.choice([0.02, 0.2, 0.3, 0.45], (200, 1))
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.concatenate([base, near, base[:1].repeat(50, axis=0)]))]
    rows += [(900, None), (901, [0.0] * size), (902, [None] + [1.0] * (size - 1)), (903, [float("nan")] * size), (904, [float("inf")] * size), (905, []), (906, [1.0]), (907, [3.0]), (908, [-1.0])]
    out = ve.near_vectors(frame(spark, rows, "vec_id bigint, embedding array<double>").repartition(6)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == plain_vectors(rows)
    assert len(out) == len(rows)


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (None, [1.0, 0.0], 1), (3, [1e300, 1e300], 1), (4, [1e-300, 1e-300], 1)]
    docs = frame(spark, rows, "vec_id bigint, embedding array<double>, rep int")
    out = ve.near_vectors(docs).collect()
    assert len(out) == 6
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {
        1: (1, 1, True), 2: (1, 1, False), None: (0, None, False), 3: (1, 3, True), 4: (1, 3, False)
    }
    assert ve.near_vectors(docs.limit(0)).collect() == []


def test_vectors_of_many_lengths(spark, monkeypatch):
    """More lengths than cells: most have no centre of their own."""
    rng = np.random.default_rng(8)
    rows = []
    for size in range(1, 301):
        v = rng.standard_normal(size)
        rows += [(3 * size, v.tolist()), (3 * size + 1, (v + 0.05 * rng.standard_normal(size)).tolist()), (3 * size + 2, (-v).tolist())]
    monkeypatch.setattr(ve, "CHUNK", 8)
    out = ve.near_vectors(frame(spark, rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == plain_vectors(rows)


def held(spark):
    """Bytes of shuffles on this machine's disk and of tables in the shared folder."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return sum(p.stat().st_size for top in (*local, shared) for p in Path(top).rglob("*") if p.is_file())


def test_vectors_move_once(spark, monkeypatch):
    """What is written follows the input, and not the pairs of chunks."""
    monkeypatch.setattr(ve, "CHUNK", 40)
    monkeypatch.setattr(ve, "LEAST_BYTES", 64 << 10, raising=False)
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((3000, 64)).astype(np.float32)
    vectors[1500:1600] = vectors[:100] + 0.1 * vectors[100:200]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    before, limit = held(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as the tables were large
    try:
        out = ve.near_vectors(table).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    written = held(spark) - before
    assert written < 8 * vectors.nbytes, written
    ones = ve.unit(vectors)
    assert {r.vec_id: r.n_links for r in out} == dict(enumerate(((ones @ ones.T >= 0.9).sum(axis=1) - 1).tolist()))


def test_vectors_in_small_blocks(spark, monkeypatch):
    """Cells dealt to several blocks, lengths that the sample lacks, dense groups, copies and repeated rows and ids."""
    for name, value in (("CHUNK", 16), ("LEAST_BYTES", 4 << 10), ("BLOCK_BYTES", 8 << 10), ("MAX_CELLS", 6)):
        monkeypatch.setattr(ve, name, value, raising=False)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((20, 48))
    near = base[rng.integers(0, 20, 300)] + rng.standard_normal((300, 48)) * rng.choice([0.05, 0.3, 0.45], (300, 1))
    vectors = [v.astype(np.float32).tolist() for v in (*base, *near, *base[:1].repeat(40, axis=0), *base[1:4].repeat(3, axis=0))]
    vectors += [rng.standard_normal(n).astype(np.float32).tolist() for n in (1, 2, 3, 3, 7)]
    rows = list(enumerate(vectors))
    for kind in ("float", "double"):
        out = ve.near_vectors(frame(spark, rows + rows[::3] + rows[20:21] * 60, f"vec_id bigint, embedding array<{kind}>").repartition(5)).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == plain_vectors(rows)
        assert len(out) == len(rows) + len(rows[::3]) + 60


def test_signed_zeros_are_equal(spark):
    out = ve.near_vectors(frame(spark, [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [-0.0, 0.0]), (4, [1.0, -1.0])], "vec_id bigint, embedding array<float>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_pigeonhole_loses_nothing():
    rng = np.random.default_rng(0)
    a = ve.unit(rng.normal(size=(400, 64)))
    b = ve.unit(np.concatenate([a[:200] + rng.normal(size=(200, 64)) * rng.uniform(0, 0.08, (200, 1)), rng.normal(size=(200, 64))]))
    i, j = ve.links(a, b, 0.9)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.9)), strict=True))


def test_registered_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in read(spark, sf_dir, "embeddings").collect()]
    found = all_queries()["op9_embedding_neardup"](spark, sf_dir).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == plain_vectors(rows)


def hit(masks, n, gone):
    return any(all(m[k] == "0" or at + k not in gone for k in range(len(m))) for m in masks for at in range(n - len(m) + 1))


def test_masks_tolerate_substitutions():
    assert all(hit(de.MASKS, 13, set(g)) for g in itertools.combinations(range(13), 2))
    three = [hit(de.MASKS, 14, set(g)) for g in itertools.combinations(range(14), 3)]
    assert np.mean(three) > 0.97
    assert all(hit(de.MASKS, 10, set(g)) for g in itertools.combinations(range(10), 2))


def promised(n, gone):
    """Whether an item of n words counts as found where the words ``gone`` are replaced, every stretch tried."""
    least = min(de.MIN_MATCHES, -(-4 * n // 5))
    for a in range(n):
        for b in range(a + 1, n + 1):
            same = sum(i not in gone for i in range(a, b))
            if same >= least and 5 * same >= 4 * (b - a):
                return True
    return False


@pytest.mark.parametrize("n", [10, 11, 12, 13, 14])
def test_every_promised_pattern_is_found(spark, n):
    """All ways of replacing up to three words of an item, inside a document and at its ends with words cut off."""
    words = [f"w{i}" for i in range(n)]
    docs, expected = [], {}
    for k in range(4):
        for gone in itertools.combinations(range(n), k):
            text = [w if i not in gone else "zz" for i, w in enumerate(words)]
            docs.append(["before", *text, "after"])
            expected[len(docs) - 1] = promised(n, set(gone))
            for a, b in [(1, n), (0, n - 1), (2, n), (0, n - 2), (1, n - 1)]:
                cut = {*gone, *range(a), *range(b, n)}
                if len(cut) <= 3:
                    docs.append(text[a:b])
                    expected[len(docs) - 1] = promised(n, cut)
    table = docs_of(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])
    found = {r.doc_id for r in de.overlaps(table, frame(spark, [(1, " ".join(words))], "item_id bigint, text string")).collect()}
    assert found == {i for i, yes in expected.items() if yes}


def item(rng, n):
    return [f"{rng.choice('abcdefghij')}{rng.randrange(400)}" for _ in range(n)]


def test_overlaps(spark):
    rng = random.Random(5)
    items = [(i, item(rng, rng.randint(15, 60))) for i in range(30)]
    docs, expected = [(500, None), (501, ""), (502, "short")], set()
    for i in range(80):
        w = item(rng, rng.randint(0, 80))
        if i % 2:
            number, text = rng.choice(items)
            part = list(text[: rng.randint(14, len(text))] if len(text) > 14 else text)
            for at in rng.sample(range(len(part)), 2):
                part[at] = "zzz"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in part]
            expected.add((i, number))
        docs.append((i, " \n".join(w)))
    bench = frame(spark, [(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "too short")], "item_id bigint, text string")
    found = de.overlaps(docs_of(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    texts, tests = dict(docs), dict(items)
    for r in found:
        a, b = lowered(texts[r.doc_id])[r.doc_start : r.doc_end], [x.lower() for x in tests[r.item_id]][r.item_start : r.item_end]
        same = sum(x == y for x, y in zip(a, b, strict=True))
        assert same == r.n_matched >= 10 and same >= 0.8 * len(a)
    kept = {r.doc_id for r in de.decontaminated(docs_of(spark, docs), bench).collect()}
    assert kept == set(texts) - {d for d, _ in expected}


def test_overlap_edges(spark):
    text = " ".join(f"q{i}" for i in range(20))
    bench = frame(spark, [(1, text), (1, text), (2, text), (None, text)], "item_id bigint, text string")
    docs = docs_of(spark, [(7, text), (7, text), (None, text), (8, "other")])
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in de.overlaps(docs, bench).collect()) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2)]
    assert de.overlaps(docs, bench.limit(0)).collect() == []
    assert de.overlaps(docs.limit(0), bench).collect() == []
    assert [r.doc_id for r in de.decontaminated(docs, bench).collect()] == [8]
    assert len(de.decontaminated(docs, bench.limit(0)).collect()) == 4


def test_short_items_are_found(spark):
    nine, five, two = "One two three four five six seven eight nine", "what is the capital city", "yes no"
    ten = "the quick brown fox jumps over lazy dogs every morning"
    bench = frame(spark, [(1, nine), (2, five), (3, two), (4, ""), (5, None), (6, ten)], "item_id bigint, text string")
    docs = [(1, nine.upper()), (2, f"before {nine} after"), (3, f"so {five} of it"), (4, two), (5, f"say {two} now"), (6, "what is the capital")]
    docs += [(7, nine.replace("four", "x")), (8, ten.replace("quick", "x").replace("brown", "y"))]
    found = {(r.doc_id, r.item_id, r.doc_start, r.doc_end, r.n_matched) for r in de.overlaps(docs_of(spark, docs), bench).collect()}
    assert found == {(1, 1, 0, 9, 9), (2, 1, 1, 10, 9), (3, 2, 1, 6, 5), (4, 3, 0, 2, 2), (8, 6, 0, 10, 8)}
    assert {r.doc_id for r in de.decontaminated(docs_of(spark, docs), bench).collect()} == {5, 6, 7}


def test_registered_overlaps(spark, sf_dir):
    """Every item that a document holds ten words of in a row is found, and nothing else."""
    bench = [(r.item_id, lowered(r.text)) for r in read(spark, sf_dir, "benchmark").collect()]
    grams = {}
    for i, w in bench:
        for p in range(len(w) - 9):
            grams.setdefault(tuple(w[p : p + 10]), set()).add(i)
    expected = set()
    for r in read(spark, sf_dir, "documents").collect():
        w = lowered(r.text)
        expected |= {(r.doc_id, i) for p in range(len(w) - 9) for i in grams.get(tuple(w[p : p + 10]), ())}
    found = {(r.doc_id, r.item_id) for r in all_queries()["op3_decontamination"](spark, sf_dir).collect()}
    assert expected and found == expected


def test_words_of_a_batch():
    from framewright.llm.text import Words, text_slices
    import pyarrow as pa

    texts = ["a b  c", "", None, " x\ty\n", "é ü", "one\x0btwo\x0cthree\r", "  \x1c", "a b c"]
    for first, data, offsets in text_slices(pa.record_batch({"text": texts})):
        w = Words(data, offsets)
        for i in range(len(offsets) - 1):
            mine = [bytes(data[s:e]).decode() for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
            assert mine == words(texts[first + i])
        assert len(set(w.hash.tolist())) == len({bytes(data[s:e]) for s, e in zip(w.start, w.end, strict=True)})

"""Collocations, chat formatting and ranked search, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import frame
from compare import duck, duck_rows, schema_differences, spark_rows

from framewright.llm import chat as ch
from framewright.llm import collocations as co
from framewright.llm import lexical as lx
from framewright.llm.queries import all_queries, all_sql

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("name", ["op11_collocations", "op12_chat_formatting", "op13_lexical_search"])
def test_registered_query_matches_sql(spark, sf_dir, name):
    found, con = all_queries()[name](spark, sf_dir), duck(sf_dir)
    assert schema_differences(found, con, all_sql()[name]) == {}
    assert spark_rows(found) == duck_rows(con, all_sql()[name])


# collocations


def collocations(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        longer = [(p, a) for p, a in counts.items() if len(p) == 3 and a >= least]
        for phrase, a in counts.items():
            if len(phrase) == 1 or a < least:
                continue
            if len(phrase) == 2 and any(phrase in (p[:2], p[1:]) and 100 * b >= share * a for p, b in longer):
                continue
            cuts = [(1_000_000 * a * a // (counts[phrase[:k]] * counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_corpus(seed):
    rng = random.Random(seed)
    names = ["a", "b", "B", "c", "\x01", "b\x02", "é", "|", "x" * 40, "über"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]
    rows = [(None, None), ("de", None), ("de", ""), ("de", " .,\n"), ("", "a b a b a b"), ("und", "a b c a b c")]
    for _ in range(60):
        words = [rng.choice(names[: rng.randint(2, 10)]) + rng.choice(gaps) for _ in range(rng.randint(1, 120))]
        rows.append((rng.choice(["de", "de", "en", None]), "".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("parts", "chunk", "stream"), [(1, 1 << 24, 1 << 16), (7, 200, 5)])
def test_collocations(spark, monkeypatch, seed, parts, chunk, stream):
    """Also with runs that go over many ranges, chunks and batches."""
    monkeypatch.setattr(co, "STREAM_ROWS", stream)
    rows = phrase_corpus(seed)
    docs = frame(spark, [(lang, t, 1, "k") for lang, t in rows], "lang string, text string, n int, key string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = sorted(map(tuple, co.collocations(docs, least=3, share=50, top=25, chunk_bytes=chunk).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    expected = collocations(rows, 3, 50, 25)
    assert found == expected and {"de", "en", "und"} <= {r[0] for r in found}


def test_counts_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    big = 3_000_000_000_000
    row = spark.createDataFrame([(big, big + 1, big * 3)], "a bigint, l bigint, r bigint")
    assert row.select(co._score("a", "l", "r")).first()[0] == 1_000_000 * big * big // ((big + 1) * big * 3)


def test_no_collocations(spark):
    assert co.collocations(frame(spark, [], "lang string, text string")).collect() == []
    assert co.collocations(frame(spark, [("de", None), (None, "ein Wort")], "lang string, text string")).collect() == []


def test_runs_of_one_word(spark):
    rows = [("de", "ja " * 50_000)]
    found = co.collocations(frame(spark, rows, "lang string, text string"), chunk_bytes=1000).collect()
    assert sorted(map(tuple, found)) == collocations(rows, 10, 50, 2000)


# chat formatting

TEXTS = ["", "hi", " <turn>", "<\\\\</turn>", "<\\text><text>", "\\<turn", "</turn", "\n\n x", "é" * 5, "<turn><turn>", "\\### Assistant: </turn> ok", "a" * 4000, "\x00<|endoftext|>"]


def test_escapes_are_reversible():
    rng = random.Random(3)
    parts = ["<", "\\", "/", "turn>", "text>", "|", "a", "<turn>", "</turn>", "<\\turn>"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        held = ch.escape(text)
        assert ch.unescape(held) == text
        assert not any(c in held for c in ch.CONTROL)


def conversation_rows(seed):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "x"), (None, 0, "assistant", "y"), (9, None, "assistant", "first"), (9, 0, None, None), (8, 0, "assistant", None)]
    for conv in range(30):
        for turn in range(rng.choice([1, 2, 5, 40])):
            rows.append((conv + 100, turn, rng.choice(["system", "user", "assistant", "assis<turn>tant"]), rng.choice(TEXTS)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "part"), [(1, 4 << 20), (2, 50), (3, 1)])
def test_conversations(spark, seed, part):
    """Also cut into many parts; the digests come from tokens, masks and text as written."""
    rows = conversation_rows(seed)
    table = frame(spark, [(*r, 1, "z") for r in rows], "conv_id bigint, turn int, role string, text string, part int, ids string")
    formatted = ch.format_conversations(table, *VOCABULARY, part_chars=part)
    found = {r.conv_id: tuple(r)[1:] for r in ch.conversation_digests(formatted, *VOCABULARY).collect()}
    expected = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        chars = sum(len(f"<turn>{ch.escape(role)}<text>{ch.escape(text)}</turn>") for _, role, text in turns)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learned)]
        expected[conv] = (len(turns), sha[0], len(learned), sha[1], chars)
    assert found == expected


def test_masks_meet_the_texts_exactly(spark):
    """Every masked range decodes to one escaped assistant text, and the tokens to the whole text."""
    vocabulary = ch.chat_vocabulary(*VOCABULARY)
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TEXTS * 2)]
    (row,) = ch.format_conversations(frame(spark, rows, "conv_id bigint, turn int, role string, text string").coalesce(1), *VOCABULARY).collect()
    assert vocabulary.decode(row.ids).decode() == row.formatted
    texts = [ch.unescape(vocabulary.decode(row.ids[s.first : s.end]).decode()) for s in row.loss]
    assert texts == [t for _, _, role, t in rows if role == "assistant" and t]
    assert ch.read_turns(row.formatted) == [(role, t) for _, _, role, t in rows]


def test_token_spans():
    ends = np.cumsum([2, 3, 1, 4])
    assert ch.token_spans(ends, np.array([[0, 10], [2, 6], [3, 9], [5, 5]])).tolist() == [[0, 4], [1, 3], [2, 3], [2, 2]]


def test_no_conversations(spark):
    empty = frame(spark, [], "conv_id bigint, turn bigint, role string, text string")
    assert ch.conversation_digests(ch.format_conversations(empty, *VOCABULARY), *VOCABULARY).collect() == []


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, k):
    texts = [(i, TERM.findall((t or "").translate(_LOWER))) for i, t in docs]
    texts = [(i, w) for i, w in texts if w]
    n_docs, n_words = len(texts), sum(len(w) for _, w in texts)
    counts = [(i, len(w), Counter(w)) for i, w in texts]
    df = Counter(t for _, _, c in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(TERM.findall((text or "").translate(_LOWER)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, n, c in counts:
            m = 10 + 90 * n * n_docs // n_words
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        out += [(item, rank, None if void else i, -s) for rank, (s, void, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def search_tables(seed, n=300):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(60)] + ["Über", "ÜBER", "Of", "of", "a-b", "x_y"]
    weights = [1 / (i + 1) for i in range(len(names))]
    docs = [(1, None), (2, ""), (3, " .,_"), (4, "t1 " * 5000), (None, "t1 t5 t40"), (6, "of"), (6, "of")]
    while len(docs) < n:
        docs.append((len(docs) + 10, rng.choice([" ", ", ", "\n"]).join(rng.choices(names, weights, k=rng.randint(1, 60)))))
    docs += [(i + 5000, t) for i, t in docs[20:60]]
    items = [(i, " ".join(rng.sample(names, rng.randint(1, 25)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "t1 t1 T1"), (53, "t40"), (None, "t3 t59")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("queries", "block"), [(2000, 4096), (4, 20), (1, 3)])
def test_ranked_search(spark, seed, queries, block):
    docs, items = search_tables(seed)
    table = frame(spark, [(i, t, 1, "d") for i, t in docs], "doc_id bigint, text string, score int, term string").repartition(3)
    asked = frame(spark, [(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int")
    found = lx.ranked_search(table, asked, k=5, block_queries=queries, block_docs=block).collect()
    assert sorted(map(tuple, found), key=str) == search(docs, items, 5)


def test_accumulators_are_limited():
    """Of documents that cannot reach the kth score only those that have an accumulator are summed, and the best stay exact."""
    rng = np.random.default_rng(5)
    limited = 0
    for _ in range(200):
        size, k = 60, int(rng.integers(1, 8))
        postings = []
        for terms in range(8):
            docs = np.sort(rng.choice(size, rng.integers(1, 8 * terms + 2), replace=False))
            postings.append((docs, rng.integers(0, 2000 // (terms + 1) ** 2 + 2, len(docs))))
        whole = np.zeros(size, np.int64)
        for docs, adds in postings:
            whole[docs] += adds
        bar = int(np.sort(whole)[-k]) if rng.random() < 0.5 else 0
        found = lx.accumulate(postings, size, k, bar)
        least = max(int(np.sort(whole)[-k]), 1, bar)
        assert (found[whole >= least] == whole[whole >= least]).all() and (found <= whole).all()
        limited += bool(((found == 0) & (whole > 0)).any())
    assert limited > 50


def test_search_without_rows(spark):
    none, some = frame(spark, [], "doc_id bigint, text string"), frame(spark, [(1, "a b")])
    items = frame(spark, [(1, "a")], "item_id bigint, text string")
    assert lx.ranked_search(none, items).collect() == []
    assert lx.ranked_search(some, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in lx.ranked_search(frame(spark, [(1, "a b"), (2, "c")]), items).collect()] == [(1, 1, 1)]

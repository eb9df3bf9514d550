"""Plain one-process versions of the operators' contracts, and small hand-made tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return words((text or "").translate(_LOWER))


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


class Parts:
    def __init__(self, vertices):
        self.up = {v: v for v in vertices}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def repeats(docs, width):
    """doc_id -> (n_words, n_removed, kept) for documents with different ids."""
    starts = {}
    for i, text in docs:
        w = words(text)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            starts[key] = min(starts.get(key, i), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = set()
        for p in range(len(w) - width + 1):
            if starts[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def shingles(text, size):
    w = lowered(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[p : p + size]) for p in range(max(1, len(w) - size + 1)))


def jaccard(docs, size, percent):
    """doc_id -> (n_shingles, component_id) for documents with different ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    parts = Parts(sets)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parts.join(a, b)
    return {i: (len(s), parts.find(i)) for i, s in sets.items()}


def corpus(seed, n=150, vocabulary=60, longest=220):
    """Random texts among them exact and near copies, shared passages, empty and null ones."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)] + ["Ünï", "The", "the", "|", "..."]
    passage = " ".join(rng.choice(names) for _ in range(30))
    texts = [None, "", "  \n\t", "one", "One", "two words", "a b c", "x" * 3000]
    while len(texts) < n:
        kind, old = rng.random(), [t for t in texts if t and len(t) > 80]
        if old and kind < 0.3:
            w = rng.choice(old).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(names)
            texts.append(rng.choice([" ", "  ", "\n"]).join(w))
        elif old and kind < 0.4:
            texts.append(rng.choice(old))
        else:
            w = [rng.choice(names) for _ in range(rng.randint(1, longest))]
            if kind > 0.7:
                w.insert(rng.randrange(len(w)), passage)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)

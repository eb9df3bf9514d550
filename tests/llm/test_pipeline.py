"""Every stage of the pipeline against a brute-force version, on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline as cp
import pytest
from brute import frame, jaccard, lowered

from framewright.llm import pii
from framewright.llm.components import stored
from framewright.llm.registry import read


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    out = [read(spark, sf_dir, "documents")]
    for _, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), "test"))
    return out


def test_columns(kept):
    for docs in kept[:-1]:
        assert docs.columns == kept[0].columns and docs.dtypes == kept[0].dtypes


def test_good_documents_stay(spark, sf_dir, kept):
    labels = {r.doc_id: r.quality for r in read(spark, sf_dir, "labels").collect()}
    ids = {r.doc_id for r in kept[1].collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in ids for d in good) >= 0.98 * len(good)
    assert sum(d in ids for d in bad) <= 0.1 * len(bad)


def test_one_of_each_group_stays(kept):
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    expected = {i for i, (_, c) in jaccard(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in kept[2].collect()} == expected


def test_no_benchmark_passage_is_left(spark, sf_dir, kept):
    grams = {tuple(w[p : p + 10]) for r in read(spark, sf_dir, "benchmark").collect() for w in [lowered(r.text)] for p in range(len(w) - 9)}
    clean = set()
    for r in kept[2].collect():
        w = lowered(r.text)
        if not any(tuple(w[p : p + 10]) in grams for p in range(len(w) - 9)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in kept[3].collect()} == clean


def test_personal_data_is_replaced(kept):
    before = {r.doc_id: r.text for r in kept[3].collect()}
    after = {r.doc_id: r for r in kept[4].collect()}
    assert set(before) == set(after)
    for d, text in before.items():
        assert after[d].n_chars == len(after[d].text)
        assert (after[d].text == text) == (not pii.find(text))
        assert not pii.find_base(after[d].text)


def test_encoded_texts_decode(kept):
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    for r in kept[5].collect():
        assert r.n_tokens == len(r.ids) and r.n_bytes == len(texts[r.doc_id].encode())


def test_edges(spark, sf_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int"
    text = "A plain sentence about nothing in particular, written for this test only."
    rows = [(1, text, "en", "s", 5, 1), (1, text, "en", "s", 5, 1), (None, None, None, None, None, None), (2, "", "en", "s", 0, 1)]
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, frame(spark, rows, schema), sf_dir).count() == 4
    for _, stage in cp.STAGES:
        assert stage(spark, frame(spark, [], schema), sf_dir).count() == 0


def test_run(spark, sf_dir, kept):
    assert {r.doc_id for r in cp.run(spark, sf_dir).collect()} == {r.doc_id for r in kept[5].collect()}

"""Operators that work row by row: encoding, personal data, pages, URLs, quality, shards."""

from __future__ import annotations

import random
import re
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import frame, sha
from pyspark.sql import functions as F

from framewright.llm import bpe, extraction, pii, quality, shards, url
from framewright.llm.map_queries import META, multilingual_encoder
from framewright.llm.queries import all_queries
from framewright.llm.registry import read
from framewright.llm.url_queries import RULES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = {t: i for i, t in enumerate(vocabulary.tokens) if t}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(rng, n):
    some = ["a", "b", " ", "  ", "\n", "'re", "'", "r", "e", "1", "23", "é", "😀", "\t", "\xa0", "...", "they'll ", "\x1c", "\x85"]
    return "".join(rng.choice(some) for _ in range(n))


@pytest.mark.parametrize("leaf", [2, 3, 7, 64])
def test_tree_encoding_equals_the_library(vocabulary, library, leaf):
    rng = random.Random(leaf)
    for _ in range(1500):
        text = pieces(rng, rng.randint(0, 60))
        ids = vocabulary.encode(text, leaf)
        assert ids == library.encode_ordinary(text)
        assert vocabulary.decode(ids, leaf) == text.encode()


@pytest.mark.parametrize("text", ["x" * 50_000, " " * 50_000, "\n" * 20_000 + "a", "1" * 50_000, "ab" * 20_000 + " c", "<|endoftext|>"])
def test_long_runs_are_encoded(vocabulary, library, text):
    assert vocabulary.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("pattern", [r"[^\s]+[\r\n]*|\s+", r".+|\n", r"\w+ ?|\s|[^\w\s]+"])
def test_patterns_without_certain_cuts_are_refused(pattern):
    with pytest.raises(ValueError, match="white space"):
        bpe.check_pattern(pattern)
    bpe.check_pattern(public_tokenizers.PATTERN)


def test_ordinary_texts_are_trees(vocabulary, library, spark, sf_dir, monkeypatch):
    """Most documents are encoded in parts that are joined."""
    joined = []
    real = bpe.ByteBpe.join
    monkeypatch.setattr(bpe.ByteBpe, "join", lambda self, *a: joined.append(1) or real(self, *a))
    texts = [r.text for r in read(spark, sf_dir, "documents").collect()]
    trees = 0
    for text in texts:
        before = len(joined)
        assert vocabulary.encode(text) == library.encode_ordinary(text)
        trees += len(joined) > before
    assert trees > len(texts) / 2


def test_encode_decode_keeps_every_row(spark, library):
    rows = [(1, "Hello there", 9), (1, "Hello there", 9), (2, None, 9), (3, "", None), (None, "é" * 9000, 1)]
    out = bpe.encode_decode(frame(spark, rows, "doc_id bigint, text string, ids int"), PATH, public_tokenizers.PATTERN)
    found = sorted(((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in out.collect()))
    assert found == sorted((i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    empty = frame(spark, [], "doc_id bigint, text string")
    assert bpe.encode_decode(empty, PATH, public_tokenizers.PATTERN).collect() == []


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_base(text):
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                yield kind, *m.span()


def test_base_spans_equal_the_plain_patterns():
    rng, hits = random.Random(1), 0
    for _ in range(30_000):
        text = "".join(rng.choice("a@.-1 25+()0é9%_@.1") for _ in range(rng.randint(0, 40)))
        expected = sorted(plain_base(text))
        hits += len(expected)
        assert sorted(pii.find_base(text)) == expected
    assert hits > 500


@pytest.mark.parametrize("text", ["a" * 100_000, "1" * 100_000, "1." * 50_000, "+1" * 50_000, "a@" * 50_000, "AB12 " * 20_000])
def test_patterns_take_linear_time(text):
    pii.find(text)


def test_added_kinds_need_checksum_or_context():
    kinds = lambda t: [s["kind"] for s in pii.find(t)]
    assert kinds("bank GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("bank GB83 WEST 1234 5698 7654 32 now") == []
    assert kinds("number 123-45-6789") == []
    assert kinds("social security 123-45-6789") == ["ssn"]


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("DE89 3704 0044 0532 0130 00 BIC COBADEFF now", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000 EUR 100", ["DE89370400440532013000"]),
        ("AB12 DE89370400440532013000 GB82 WEST 1234 5698 7654 32 OK", ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]),
        ("DE89370400440532013000 " + "9" * 40, ["DE89370400440532013000"]),
        ("NO9386011117947", ["NO9386011117947"]),
        ("DE89370400440532013000x DE89370400440532013001 A1", []),
        ("XX89 3704 0044 0532 0130 00 BIC", []),
    ],
)
def test_account_numbers_end_where_their_checksum_holds(text, spans):
    assert [text[s:e] for k, s, e in pii.find_added(text) if k == "iban"] == spans


def test_account_numbers_before_any_word():
    """Whatever follows, the number is found with its own end, and nothing that was found before is lost."""
    rng = random.Random(8)
    for _ in range(3000):
        country, length = rng.choice(list(pii._LENGTHS.items()))
        body = "".join(rng.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(length - 4))
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        plain = f"{country}{check:02d}{body}"
        written = rng.choice([plain, " ".join(plain[i : i + 4] for i in range(0, length, 4))])
        tail = " ".join("".join(rng.choice("AB01") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 5)))
        text = f"to {written} {tail}".rstrip() + rng.choice(["", ".", " now", ", then"])
        assert ("iban", 3, 3 + len(written)) in pii.find_added(text)


def test_personal_data_rows(spark):
    text = "mail é bo@x.org or 10.0.0.1"
    rows = [(1, text, 1), (1, text, 1), (2, None, 2), (3, "", 3), (None, "x" * 100_000, 4)]
    docs = frame(spark, rows, "doc_id bigint, text string, spans int")
    out = pii.personal_data(docs).collect()
    assert sorted(len(r.spans) for r in out) == [0, 0, 0, 2, 2]
    assert [(s.kind, s.start, s.end) for s in max(out, key=lambda r: len(r.spans)).spans] == [("email", 7, 15), ("ip", 19, 27)]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[1] == "mail é <email> or <ip>" and clean[2] is None and clean[3] == ""
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_whole_article_of_every_page(spark, sf_dir):
    pages = {r.page_id: r for r in read(spark, sf_dir, "pages").collect()}
    for row in all_queries()["op1_html_extraction"](spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[row.page_id].html, re.S)[1]
        inner = re.sub(r"</?(p|h1|br)>", " ", re.sub("</?b>", "", inner))
        assert row.text == " ".join(unescape(inner).split())
        assert row.n_chars == len(row.text) and row.url == pages[row.page_id].url


LONG = "This paragraph is long enough to stand out among the links around it, as articles do. "


def test_regions_without_an_article():
    page = f"""<body><header><h1>Site</h1></header><div class="menu"><a href=x>Home</a> <a>News</a></div>
    <div id="text"><h2>A title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}in<i>line</i> &amp; &eacute;</p></div>
    <div class="sidebar">Related</div><div id="comments"><p>{LONG}</p></div><form>{LONG}</form><footer>c</footer>"""
    once = " ".join(LONG.split())
    assert extraction.main_text(page) == f"A title {once} Short. {once} inline & é"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b", "a b"),
        ("plain &lt; text", "plain < text"),
        ("<div class=ad>x</div>", ""),
        ("<article>a<div class='notice'>n</div><script>'</p>'</script><!-- c -->b</article>", "a b"),
        ("<main><p class=ad>x<p>y</main>", "y"),
        (f"<p>{LONG}</p><article>z</article>", "z"),
    ],
)
def test_small_pages(page, text):
    assert extraction.main_text(page) == text


ONCE = " ".join(LONG.split())
LINKS = "".join(f'<li><a href="/{i}">More about subject {i}</a></li>' for i in range(6))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="content has-sidebar"><article><p>{LONG}</p></article></div>', ONCE),
        (f'<div id="search-wrap"><div class="widget"><main><p>{LONG}</p></main></div></div><p>out</p>', ONCE),
        (f'<form id="page"><article><p>{LONG}</p></article></form>', ONCE),
        (f'<div class="no-sidebar related"><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div><div>x</div>', f"Title {ONCE} {ONCE}"),
        (f'<article><p>{LONG * 3}</p><p>Short.</p><div id="comments"><article>Nice</article></div></article>', f"{' '.join([ONCE] * 3)} Short."),
        (f"<article><p>{LONG}</p><p>{LONG}</p><section><p>Short.</p></section><ul>{LINKS}</ul></article>", f"{ONCE} {ONCE} Short."),
        (f"<article><p>{LONG}</p><p>{LONG}</p><ul><li>Milk</li><li>Eggs</li></ul></article>", f"{ONCE} {ONCE} Milk Eggs"),
    ],
)
def test_class_words_of_wrappers(page, text):
    assert extraction.main_text(page) == text


P = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # parts of an article that are not its text go, however long they are
        (f'<article>{P}{P}<div class="comments">{P * 20}</div></article>', f"{ONCE} {ONCE}"),
        (f'<article>{P}<div class="advert">{P * 20}</div>{P}</article>', f"{ONCE} {ONCE}"),
        (f"<article>{P}<form><p>{LONG * 20}</p></form></article>", ONCE),
        (f'<div class="cookie-banner">{P * 9}</div><article>{P}</article>', ONCE),
        (f'<div id="cookies">{P * 9}</div><div>{P}</div>', ONCE),
        (f'<article>{P}</article><section id="comments"><article>{P * 9}</article></section>', ONCE),
        (f'<article>{P}<article class="comment">{P * 9}</article></article><article class="comment">{P}</article>', ONCE),
        (f'<div class="layout sidebar-left"><main>{P}</main><div class="related"><article>{P}</article></div></div>', ONCE),
        (f'<div class="content">{P}{P}</div><div class="comment-list">{P * 9}</div>', f"{ONCE} {ONCE}"),
        (f'<section class="comments"><article>{P}</article></section><div>{P}</div>', ONCE),
        # headlines and short neighbours stay
        (f'<article><header class="entry-header"><h1>Head</h1><p>By A</p></header>{P}</article>', f"Head {ONCE}"),
        (f"<div><h1>Head</h1></div><div>{P}{P}</div><div><p>{ONCE[:60]}</p></div><div>Imprint</div>", f"Head {ONCE} {ONCE} {ONCE[:60]}"),
        (f'<div><p>{"<a href=x>More about it</a> " * 9}</p></div><div>{P}{P}</div>', f"{ONCE} {ONCE}"),
        (f'<article class="comments-open post">{P}</article><p>{LONG}</p>', ONCE),
        ("<article><p>a" + "<b>" * 40 + "<div>b</div>c</article>", "a b c"),
    ],
)
def test_parts_that_are_not_the_article(page, text):
    assert extraction.main_text(page) == text


def test_the_clusters_decide(monkeypatch):
    """Without declared regions, what the upper cluster is decides what is returned."""
    links = "".join(f"<div><a href={i}>Go to page {i}</a></div>" for i in range(8))
    page = f"{links}<div>{P}{P}<p>Short.</p></div>{links}<div>Imprint</div>"
    assert extraction.main_text(page) == f"{ONCE} {ONCE} Short."
    for other in (lambda r: np.ones(len(r), bool), lambda r: np.arange(len(r)) == 0):
        monkeypatch.setattr(extraction, "content_lines", other)
        assert extraction.main_text(page) != f"{ONCE} {ONCE} Short."


@pytest.mark.parametrize(
    "page",
    ["<b>" * 20_000 + "</i>" * 20_000, "<div>" * 20_000, "<" * 20_000, "&" * 50_000, "<p>a<b><i>" * 20_000]
    + ["<div class=ad><article>a</article>" * 10_000, "<div class=search>a" * 10_000],
)
def test_broken_markup_takes_linear_time(page):
    extraction.main_text(page)


def test_page_rows(spark):
    rows = [(1, None, "t"), (1, None, "t"), (2, "<p>a</p>", None)]
    out = extraction.extract_text(frame(spark, rows, "page_id bigint, html string, text string")).collect()
    assert sorted(r.text for r in out) == ["", "", "a"]


URLS = [
    ("http://A.Net/x?y", "a.net", "/x", "net/", "block"),
    ("https://m.x.example.net/en/1#t", "m.x.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("https://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("https://a.org/fr/://b", "a.org", "/fr/://b", "org/fr/", "allow"),
    ("no scheme net/", "", "", None, None),
    (None, "", "", None, None),
    ("http://x.net", "x.net", "", None, None),
    ("http://", "", "", None, None),
    ("", "", "", None, None),
]


def test_rules_and_parts(spark):
    rows = [(i, u, "old") for i, (u, *_) in enumerate(URLS)] * 2
    docs = frame(spark, rows, "page_id bigint, url string, rule string")
    out = url.url_verdicts(docs, RULES, None).orderBy("page_id").collect()
    assert len(out) == 2 * len(URLS)
    for row in out:
        _, host, path, rule, verdict = URLS[row.page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdict or "allow")
    assert url.url_verdicts(docs.limit(0), RULES, None).collect() == []


def test_trees_learn_lexical_marks(spark):
    rng = random.Random(4)
    def make(bad):
        name = "".join(rng.choice("0123456789" if bad else "abcdefgh") for _ in range(12))
        return f"http://{name}.com/{'?a=1&b=2&c=3' if bad else 'page'}"
    rows = [(make(i % 2 == 0), int(i % 2 == 0)) for i in range(600)]
    model = url.train(frame(spark, rows[:400], "url string, label int"))
    judged = url.url_verdicts(frame(spark, rows[400:], "url string, label int"), [], model).collect()
    assert np.mean([(r.verdict == "block") == (r.label == 1) for r in judged]) > 0.97
    assert url.train(frame(spark, rows[:1], "url string, label int")) is None


def test_trees_learn_suffixes_that_no_rule_names(spark):
    """Hosts and paths alike, only the suffix tells; suffixes that no labelled URL has get the share of all."""
    rng = random.Random(6)
    def make(suffix):
        return f"http://{''.join(rng.choice('abcdef') for _ in range(9))}.{suffix}/page"
    rows = [(make(s), int(s in ("zzq", "qru"))) for s in ("zzq", "qru", "abd", "dec") for _ in range(150)]
    rng.shuffle(rows)
    model = url.train(frame(spark, rows[:400], "url string, label int"))
    found = {r.suffix: (r.n, r.blocked) for r in model.counts["suffix"].collect()}
    assert found == {s: (float(n), float(b)) for s in ("zzq", "qru", "abd", "dec") for own in [[y for u, y in rows[:400] if f".{s}/" in u]] for n, b in [(len(own), sum(own))]}
    judged = url.url_verdicts(frame(spark, rows[400:], "url string, label int"), [], model).collect()
    assert np.mean([(r.verdict == "block") == (r.label == 1) for r in judged]) > 0.97
    odd = url.url_verdicts(frame(spark, [("http://a.new/",), (None,), ("x",)], "url string"), [], model).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)


def test_a_frequent_url_leaves_the_others_in(spark):
    rows = [("http://same.com/x", 1)] * 3000 + [(f"http://{'a9'[i % 2] * 5}{i}.com/", i % 2) for i in range(300)]
    model = url.train(frame(spark, rows, "url string, label int"), rows=200)
    judged = url.url_verdicts(frame(spark, rows[3000:], "url string, label int"), [], model).collect()
    assert np.mean([(r.verdict == "block") == (r.label == 1) for r in judged]) > 0.9


def test_clashing_names_of_url_tables(spark):
    rows = [(f"http://{'a9'[i % 2] * 5}{i}.com/", i % 2) for i in range(60)]
    model = url.train(frame(spark, rows, "url string, label int"))
    names = ["_url_length", "_features", "features", "suffix", "directory", "n", "probability", "row", "a.b", "score", "host"]
    wide = frame(spark, rows, "url string, label int").select("url", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = url.url_verdicts(wide, RULES, model)
    assert out.columns == [*names[:-2], "url", "host", "path", "rule", "score", "verdict"]
    assert {tuple(r)[: len(names) - 2] for r in out.collect()} == {tuple(range(len(names) - 2))}


def test_registered_url_model_on_held_back_rules(spark):
    """Fitted on four fifths of the URLs that rules judge, the trees agree with the rules on the rest."""
    pages = read(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")
    judged = url.url_verdicts(pages, RULES, None).where("rule is not null")
    labelled = judged.select("url", (F.col("verdict") == "block").cast("int").alias("label"))
    held = F.pmod(F.xxhash64("url", F.lit("held")), F.lit(5)) == 0
    model = url.train(labelled.where(~held))
    agree = url.url_verdicts(labelled.where(held), [], model).select((F.col("verdict") == "block").cast("int") == F.col("label"))
    assert np.mean([r[0] for r in agree.collect()]) > 0.95
    found = all_queries()["op8_url_filter"](spark, "/root/testdata/sf0.1").collect()
    parts = {r.page_id: r for r in url.url_verdicts(pages, RULES, None).collect()}
    assert len(found) == len(parts)
    for r in found:
        plain = parts[r.page_id]
        assert (r.host, r.path, r.rule) == (plain.host, plain.path, plain.rule)
        assert r.rule is None or r.verdict == plain.verdict


def test_quality_on_held_out_labels(spark):
    """Fitted without the labels of every third document, the classifier must judge those."""
    folder = "/root/testdata/sf0.01"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = quality.train(docs, labels.where("doc_id % 3 != 0"), META)
    judged = quality.quality_scores(docs, model, META).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = [r.accepted == (r.quality == 1) for r in judged]
    assert len(right) > 100 and np.mean(right) >= 0.97
    assert np.mean([r.accepted for r in judged if r.quality == 1]) >= 0.98


def co_trained_accuracy(seed, rounds):
    """Of two noisy but independent views with 60 labels between them, on rows that neither saw."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 4000).astype(float)
    views = [np.column_stack([np.ones(4000), rng.normal(size=(4000, 6)) + 1.2 * (y[:, None] - 0.5)]) for _ in range(2)]
    held = np.arange(60) % 5 == 0
    fitted = quality.co_train([v[:60] for v in views], y[:60], held, [v[60:3000] for v in views], rounds)
    model = quality.Model(*fitted, 0.5, [])
    return np.mean((model.scores(views[0][3000:], views[1][3000:])[2] >= 0.5) == (y[3000:] == 1))


def test_views_teach_each_other():
    without, with_ = ([co_trained_accuracy(seed, rounds) for seed in range(6)] for rounds in (0, 3))
    assert np.mean(with_) > np.mean(without) + 0.01 and np.mean(with_) > 0.94


def test_every_unlabelled_row_takes_part(spark):
    """More sure guesses than a round once passed on, and rows beyond the pool there once was: all are summed over."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 13_000).astype(float)
    views = [np.column_stack([np.ones(13_000), 6 * (y[:, None] - 0.5) + rng.normal(size=(13_000, 2))]) for _ in range(2)]
    held = np.arange(200) % 5 == 0
    pools = [v[200:] for v in views]
    rows = [(list(map(float, a)), list(map(float, b))) for a, b in zip(*pools, strict=True)]
    pool = frame(spark, rows, "tx array<double>, mx array<double>").repartition(7)
    local = quality.co_train([v[:200] for v in views], y[:200], held, pools)
    total = quality.summed_over(pool)
    assert total(lambda x: np.array([len(x[0])])) == [12_800]
    assert quality.summed_over(pool.repartition(300))(lambda x: np.array([len(x[0])])) == [12_800]
    assert quality.summed_over(pool.limit(0))(lambda x: np.array([len(x[0])])) is None
    spread = quality.co_train([v[:200] for v in views], y[:200], held, total)
    taught = [x for x, _ in quality._taught(pools, local)]
    assert min(map(len, taught)) > 10_000
    for a, b, x in zip(local, spread, views, strict=True):
        assert np.allclose(a.odds(x), b.odds(x), atol=1e-3)
        whole = np.concatenate([x[:200][~held], pools[0 if x is views[0] else 1]])
        assert np.abs(a.mean - whole.mean(axis=0))[1:].max() < 0.2


def test_quality_pool_is_the_corpus(spark):
    """A document's score follows every unlabelled document: none is left out of the pool."""
    seen = []
    folder = "/root/testdata/sf0.001"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    rows = docs.union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = rows.crossJoin(spark.range(60).withColumnRenamed("id", "n")).withColumn("doc_id", F.expr("doc_id + n * 1000000"))
    real, quality.co_train = quality.co_train, lambda *a: seen.append(a[3](lambda x: np.array([len(x[0])])).tolist()) or real(*a[:3], [x[:0] for x in a[0]], 0)
    try:
        quality.train(rows.drop("n"), labels, META)
    finally:
        quality.co_train = real
    known = docs.join(labels, "doc_id", "left_semi").count()
    assert seen == [[rows.count() - known]] and seen[0][0] > 10_000


def test_ties_of_labelled_ids_do_not_depend_on_the_order(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", *META)
    labels = read(spark, "/root/testdata/sf0.001", "labels")
    twice = docs.union(docs.withColumn("text", F.reverse("text")))
    models = [quality.train(d, labels, META) for d in (twice.repartition(3), twice.orderBy(F.desc("doc_id")).repartition(5, "text"))]
    for a, b in zip(models[0].text.__dict__.values(), models[1].text.__dict__.values(), strict=True):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-9)


def test_words_are_features():
    """Texts alike in every character statistic, told apart by their words."""
    rng = random.Random(2)
    good, bad = ["stone", "water", "light"], ["noset", "trawe", "thigl"]
    texts = [" ".join(rng.choice(good if i % 2 else bad) for _ in range(20)) for i in range(200)]
    raw = "".join(texts).encode()
    x = quality.text_features(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    y = np.arange(200) % 2
    w = quality.fit_logistic(x[:150], y[:150].astype(float))
    assert np.mean((x[150:] @ w > 0) == y[150:]) > 0.95


def test_quality_edges(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int"
    rows = [(1, None, None, None, None, 1), (1, None, None, None, None, 1), (None, "", "en", "s", 0, 1), (3, "x " * 50_000, "en", None, -5, 2)]
    docs = frame(spark, rows, schema)
    labels = frame(spark, [(1, 1), (1, 0), (1, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels, META)
    assert quality.quality_scores(docs, model, META).count() == 4
    assert quality.accepted_documents(docs, model, META).columns == docs.columns
    nothing = quality.train(docs.limit(0), labels.limit(0), META)
    assert [r.accepted for r in quality.quality_scores(docs, nothing, META).collect()] == [True] * 4


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000, 4097])
def test_feistel_permutes(size):
    out = shards.feistel(np.arange(size), size, key=3)
    assert sorted(out.tolist()) == list(range(size))
    if size >= 1000:
        assert out.tolist() != shards.feistel(np.arange(size), size, key=4).tolist()
        assert abs(np.corrcoef(np.arange(size), out.astype(float))[0, 1]) < 0.2


def test_shards_hold_every_sequence(spark, sf_dir, tmp_path, library):
    docs = read(spark, sf_dir, "documents")
    extra = docs.limit(1).select("doc_id", "text").union(frame(spark, [(None, "x"), (7_000_000, None), (7_000_001, "")]))
    docs = docs.select("doc_id", "text").union(extra).withColumn("slot", F.lit(1))
    index, folder = shards.training_order(docs, multilingual_encoder, 11, folder=str(tmp_path / "s"), shard_bytes=1 << 16)
    rows = {r.slot: r for r in index.collect()}
    assert sorted(rows) == list(range(len(rows)))
    starts = [tuple(r) for r in shards.manifest(index).select("shard", "n_records", "first_slot").collect()]
    assert len(starts) > 2
    texts = {}
    for slot, ids in enumerate(shards.read_slots(folder, starts, 0)):
        row = rows[slot]
        assert len(ids) == row.n_ids
        texts.setdefault(row.doc_id, {}).setdefault(row.seq_no, []).append(ids.tolist())
    expected = {r.doc_id: library.encode_ordinary(r.text) for r in docs.where("text != ''").collect()}
    assert {d: sum((s[n][0] for n in sorted(s)), []) for d, s in texts.items()} == expected
    assert next(shards.read_slots(folder, starts, 9)).tolist() == texts[rows[9].doc_id][rows[9].seq_no][0]
    again, _ = shards.training_order(docs.repartition(5), multilingual_encoder, 11, folder=str(tmp_path / "t"), shard_bytes=1 << 16)
    assert {r.slot: (r.doc_id, r.seq_no) for r in again.collect()} == {s: (r.doc_id, r.seq_no) for s, r in rows.items()}


@pytest.mark.parametrize("named", [0, 40])
def test_shards_of_rows_without_ids_and_of_large_vocabularies(spark, tmp_path, named):
    """Every row keeps its sequences, spread over the shards, with ids beyond 16 bits."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = [(i - 5 if i < named else None, t) for i, t in enumerate(texts)]
    def encoder():
        return lambda text: [ord(c) * 1000 for c in text]
    index, folder = shards.training_order(frame(spark, rows), encoder, 3, str(tmp_path / "n"), length=8, shard_bytes=1 << 10, vocabulary=100_000)
    starts = [tuple(r) for r in shards.manifest(index).collect()]
    assert len(starts) > 3 and max(n for _, n, _ in starts) < index.count() / 2
    starts = [tuple(r) for r in shards.manifest(index).select("shard", "n_records", "first_slot").collect()]
    found = [ids.tolist() for ids in shards.read_slots(folder, starts, 0, length=8, vocabulary=100_000)]
    expected = [[ord(c) * 1000 for c in t[i : i + 8]] for t in texts for i in range(0, len(t), 8)]
    assert sorted(found) == sorted(expected)
    assert sorted(r.n_ids for r in index.where("doc_id is null").collect()) == sorted(len(t[i : i + 8]) for t in texts[named:] for i in range(0, len(t), 8))
    with pytest.raises(Exception, match="OverflowError|out of bounds"):
        shards.training_order(frame(spark, rows), encoder, 3, str(tmp_path / "o"), length=8)


def test_shards_of_nothing(spark, tmp_path):
    index, _ = shards.training_order(frame(spark, []), multilingual_encoder, 1, folder=str(tmp_path / "none"))
    assert index.collect() == []


def test_registered_encoding_digests(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    for r in all_queries()["op4_byte_bpe"](spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(texts[r.doc_id])


def test_registered_spans_digests(spark, sf_dir):
    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    order = list(BASE)
    for r in all_queries()["op10_pii"](spark, sf_dir).collect():
        spans = sorted(plain_base(texts[r.doc_id]), key=lambda s: (s[1], order.index(s[0])))
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == sha(joined)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in order]

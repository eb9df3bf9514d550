"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Some of the features are statistics of the host's suffix, and of the path's first directory, over all labelled URLs: how
many have it, and what share of them is to be blocked, drawn towards the share of all. A URL that the trees are fitted on
gets them from the URLs of other folds, so that its own label is not among its features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.components import prepare, stored

#: Different labelled URLs the trees are fitted on, at most; which ones is decided by a hash of the URL.
TRAIN_ROWS = 20_000
TREES = 10
DEPTH = 4
BLOCK_FROM = 0.5
#: Folds of the labelled URLs; a URL's suffix is judged by the others.
FOLDS = 5
#: How many URLs the share of all weighs in the share of one suffix.
PRIOR = 10.0


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lowered; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lowered = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parse_rule(rule: str, verdict: str) -> tuple[str, str, str, str]:
    """A rule ``host/path`` as (rule, host, path, verdict); the path begins with its slash."""
    host, slash, path = rule.partition("/")
    return rule, host, slash + path, verdict


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """The rows with ``rule`` and ``rule_verdict`` of the longest rule that fits, null where none does.

    A rule fits its host and every subdomain of it, if the path starts with the rule's path. The rules are
    code, so they become one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, host, path, result in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, result).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def _share(text: Column, drop: str) -> Column:
    """The share of characters that are left when those of a pattern are dropped."""
    return F.char_length(F.regexp_replace(text, drop, "")) / F.greatest(F.char_length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the letters a-z, digits and all other characters, in bits."""
    lowered, n = F.lower(text), F.greatest(F.char_length(text), F.lit(1)).cast("double")
    total, counted = F.lit(0.0), F.lit(0)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        count = F.char_length(text) - F.char_length(F.replace(lowered, F.lit(c), F.lit("")))
        p = count / n
        total += F.when(count > 0, -p * F.log2(p)).otherwise(0.0)
        counted += count
    p = (F.char_length(text) - counted) / n
    return total + F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def parts() -> dict[str, Column]:
    """The parts of a URL that statistics are kept of."""
    return {"suffix": F.substring_index("host", ".", -1), "directory": F.regexp_extract("path", "^/([^/]*)/", 1)}


def features() -> dict[str, Column]:
    """Lexical features of ``url``, ``host`` and ``path``, and the statistics that ``_statistics`` has added."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "url_length": F.char_length(url),
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "host_depth": F.size(F.split(host, r"\.")),
        "path_depth": F.size(F.split(path, "/")),
        "digit_ratio": _share(url, "[^0-9]"),
        "host_digit_ratio": _share(host, "[^0-9]"),
        "odd_ratio": _share(url, "[A-Za-z0-9/:.]"),
        "host_hyphens": F.char_length(F.regexp_replace(host, "[^-]", "")),
        "entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "parameter_length": F.char_length(query),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "secure": F.startswith(F.lower(url), F.lit("https://")).cast("int"),
        "suffix_length": F.char_length(parts()["suffix"]),
        **{f"{part}_seen": F.log1p(f"{part}_seen") for part in parts()},
        **{f"{part}_share": F.col(f"{part}_share") for part in parts()},
    }


def _vector() -> Column:
    return array_to_vector(F.array(*[c.cast("double") for c in features().values()]))


def _statistics(part: str, n: Column, blocked: Column, share: float) -> dict[str, Column]:
    n, blocked = (F.coalesce(c, F.lit(0)).cast("double") for c in (n, blocked))
    return {f"{part}_seen": n, f"{part}_share": (blocked + PRIOR * share) / (n + PRIOR)}


@dataclass
class UrlModel:
    """Trees, and what they need: for each of ``parts`` a table of (its value, n, blocked), and the share of all that is blocked."""

    trees: GBTClassificationModel
    counts: dict[str, DataFrame]
    share: float


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> UrlModel | None:
    """Trees fitted on (url, label) rows, label 1 for block; None where only one label or none occurs.

    Every URL counts once, weighted by the logarithm of its rows. Statistics are taken over all of them; the trees are fitted
    on those nearest to zero by a hash, ``rows`` at most, so the fit costs the same at any size. A URL with both labels is one
    of each. Null URLs and labels are left out.
    """
    spark = labelled.sparkSession
    prepare(spark)
    counted = labelled.where("url is not null and label is not null").groupBy("url", F.col("label").cast("double").alias("label"))
    urls = counted.agg(F.log1p(F.count("*")).alias("weight")).withColumn("hash", F.xxhash64("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = stored(urls.withColumns({**parts(), "fold": F.pmod("hash", F.lit(FOLDS))}), "urls")
    n, blocked = urls.agg(F.count("*"), F.sum("label")).first()
    if not blocked or blocked == n:
        return None
    share, counts = blocked / n, {}
    sample = urls.orderBy("hash", "url", "label").limit(rows)
    for part in parts():
        folds = stored(urls.groupBy(part, "fold").agg(F.count("*").alias("own"), F.sum("label").alias("own_blocked")), f"{part}-folds")
        counts[part] = stored(folds.groupBy(part).agg(F.sum("own").alias("n"), F.sum("own_blocked").alias("blocked")), part)
        others = _statistics(part, F.col("n") - F.col("own"), F.col("blocked") - F.col("own_blocked"), share)
        sample = sample.join(folds, [part, "fold"]).join(counts[part], part).withColumns(others)
        sample = sample.drop("n", "blocked", "own", "own_blocked")
    sample = stored(sample.select(_vector().alias("features"), "label", "weight"), "url-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7)
    return UrlModel(trees.fit(sample), counts, share)


def url_verdicts(
    urls: DataFrame, rules: list[tuple[str, str, str, str]], model: UrlModel | None, url_column: str = "url"
) -> DataFrame:
    """Per row its columns with ``url``, ``host``, ``path``, ``rule`` (null without), ``score`` and ``verdict``.

    The verdict is the rule's where one fits, else block from a score of BLOCK_FROM. A null URL or one without ://
    has an empty host and path and is scored like any other; without a model the score is 0. An empty table gives no rows.
    Repeated rows stay; columns of these names are replaced, columns of any other name stay as they are.
    """
    own = ("url", "host", "path", "rule", "score", "verdict")
    named = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"), urls[url_column].cast("string").alias("url"))
    named = named.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    scored = with_rule(named, rules)
    if model is None:
        scored = scored.withColumn("score", F.lit(0.0))
    else:
        scored = scored.withColumns(parts())
        for part, counts in model.counts.items():
            scored = scored.join(counts, part, "left")
            scored = scored.withColumns(_statistics(part, F.col("n"), F.col("blocked"), model.share)).drop("n", "blocked")
        scored = model.trees.transform(scored.withColumn("features", _vector()))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    judged = F.coalesce("rule_verdict", F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow"))
    rest = [F.col("row")[c].alias(c) for c in urls.columns if c not in own]
    return scored.withColumn("verdict", judged).select(*rest, *own)

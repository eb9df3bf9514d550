"""Queries of the URL filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.llm.registry import query, read
from framewright.llm.url import host_of, parse_rule, path_of, train, url_verdicts, with_rule

RULES = [
    parse_rule("net/", "block"),
    parse_rule("example.net/en/", "allow"),
    parse_rule("example.com/de/", "block"),
    parse_rule("org/fr/", "allow"),
]


@query("op8_url_filter")
def op8_url_filter(spark, sf_dir):
    """The URLs that a rule judges are the labelled ones; the trees judge the others."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    parts = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labelled = with_rule(parts, RULES).where("rule_verdict is not null")
    model = train(labelled.select("url", (F.col("rule_verdict") == "block").cast("int").alias("label")))
    judged = url_verdicts(pages, RULES, model)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")

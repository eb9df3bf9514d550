"""All queries of the subpackage."""

from __future__ import annotations

import importlib

from framewright.llm.registry import ORACLES, QUERIES, Query

MODULES = ("map_queries", "url_queries", "dedup_queries", "ranking_queries", "chat_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"framewright.llm.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)

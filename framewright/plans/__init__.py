"""Named queries over the test tables."""

from __future__ import annotations

import importlib

from framewright.plans.registry import ORACLES, QUERIES, Query
from framewright.session import ship_package

MODULES = ("frame", "message", "session", "detection", "dataset", "stream", "source", "model")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"framewright.plans.{name}_queries")


def _shipped(fn: Query) -> Query:
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    _load()
    return {name: _shipped(fn) for name, fn in QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)

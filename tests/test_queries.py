"""Every registered query runs; those with SQL must match it in names, types and values."""

from __future__ import annotations

import pytest
from compare import duck, duck_rows, schema_differences, spark_rows

from framewright.plans import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    result = QUERIES[name](spark, sf_dir)
    assert schema_differences(result, con, SQL[name]) == {}
    assert spark_rows(result) == duck_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


KEYED = [
    "throttle",
    "grouped_within",
    "chunk_stream_ids",
    "chunk_streams",
    "chunk_stream_total",
    "session_history",
    "session_snapshot",
    "session_gate",
    "host_failure_breaker",
    "request_reply_fifo",
    "balanced_sample",
    "percent_split",
    "stream_throttle",
    "stream_session_gate",
    "split_frames",
]


@pytest.mark.parametrize("name", KEYED)
def test_split_keys_give_the_same_rows(spark, sf_dir, con, split_all, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(con, SQL[name])

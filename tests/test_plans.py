"""Physical plans: what would decide the run time at scale."""

from __future__ import annotations

import re

import pytest

from framewright.operators import frames as fr
from framewright.operators import messages as ms
from framewright.operators import sessions as se
from framewright.plans import all_queries
from framewright.plans import fixtures as fx

QUERIES = all_queries()
# streams, sinks and trained models run eagerly: their result is a table scan
LAZY = sorted(n for n in QUERIES if not n.startswith(("stream_", "mlp_")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_row_udf(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(fr.throttle(fx.frames(spark, sf_dir)).select("device", "emit_ts"))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"event_id:bigint,ts:timestamp_ntz,user_id:bigint"}


def test_filters_reach_the_scan(spark, sf_dir):
    assert "PushedFilters: [In(event_type, [click,purchase,view])]" in plan(fx.chunk_log(spark, sf_dir))
    assert "EqualTo(event_type,error)" in plan(fx.host_failures(spark, sf_dir))


@pytest.mark.parametrize(
    "build",
    [
        lambda s, d: fr.throttle(fx.frames(s, d)),
        lambda s, d: fr.grouped_within(fx.frames(s, d), 5, "1 day"),
        lambda s, d: ms.chunk_stream_total(fx.chunk_log(s, d)),
        lambda s, d: fr.client_frame_counters(fx.frames(s, d)),
    ],
)
def test_one_shuffle(spark, sf_dir, build):
    assert plan(build(spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_session_history_sorts_its_rows_once(spark, sf_dir):
    text = plan(se.session_history(fx.session_events(spark, sf_dir)))
    # one shuffle of the rows, one of the per-address first events that make the timers
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("Sort [") == 1


def test_global_order_is_not_one_task(spark, sf_dir):
    from framewright.operators.ordering import with_global_index

    text = plan(with_global_index(fx.frames(spark, sf_dir), ["ts", "event_id"]))
    single = text[: text.index("Exchange SinglePartition")]
    # the only window in one task runs over the per-partition counts, below the broadcast
    assert "BroadcastExchange" in single and single.index("BroadcastExchange") < single.index("Window")


def test_hot_keys_are_cut_into_chunks(spark, sf_dir, split_all):
    from framewright.operators.ordering import KeyedScan

    scan = KeyedScan(fx.frames(spark, sf_dir), ["device"], ["ts", "event_id"])
    assert scan.split
    sizes = scan.rows.where("_chunk > 0").groupBy("device", "_chunk").count().agg({"count": "max"}).first()[0]
    assert sizes <= 40

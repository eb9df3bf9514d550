"""The server's path from received messages to outgoing replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import messages as ms
from framewright.operators.ordering import hot_keys, lookup_join
from framewright.operators.sessions import CHECK_DELAY, RESOLVE_TIMEOUT, gate_open, session_facts


def serve_messages(
    wire: DataFrame,
    session_events: DataFrame,
    timeout: float = RESOLVE_TIMEOUT,
    check_delay: float = CHECK_DELAY,
    hot_rows: int | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Replies to encoded messages (``conn``, ``ts``, ``event_id``, ``wire``) of open sessions.

    Decode, drop what does not decode, let through what each connection's gate lets through,
    route, then answer single commands outside substreams and size commands whose substream
    completed. A command inside a substream aborts it and is lost.
    """
    hot = hot_keys(session_events, ["addr"], hot_rows)
    facts = session_facts(session_events, timeout, check_delay, hot)
    opened = gate_open(facts).withColumnRenamed("addr", "conn")
    decoded = ms.decode_messages(wire).where(F.col("error").isNull())
    passed = lookup_join(decoded, opened, "conn", hot=hot and hot.renamed(conn=F.col("addr"))).where(F.col("ts") > F.col("open_ts"))
    routed = ms.chunk_roles(ms.route_extended(passed))
    segmented = ms.segment_chunks(ms.chunk_rows(routed, "tag", "cmd", "payload"), hot_rows, wire)
    single = ms.command_replies(segmented.where(F.col("stream").isNull()), labels=labels)
    sizes = ms.size_replies(ms.chunk_streams(segmented.where(F.col("stream").isNotNull())))
    columns = ["conn", "ts", "event_id", "reply"]
    replies = ms.merge_streams(single.select(*columns), sizes.select(*columns))
    answers = replies.withColumnRenamed("reply", "payload").withColumns(
        {"tag": F.lit(ms.TAG_REPLY), "cmd": F.lit(None).cast("int")}
    )
    return ms.encode_messages(answers)

"""Host connections: failure breaker, reconnects, request/reply matching, subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import seconds_interval
from framewright.operators.ordering import with_group_index

# Fixed values of the client's connection settings.
RECOVERY_PERIOD = "4 seconds"
MAX_FAILURES = 1
RECONNECT_DELAY = 2.0


def host_failure_breaker(
    failures: DataFrame,
    max_failures: int = MAX_FAILURES,
    period: str = RECOVERY_PERIOD,
    hot_rows: int | None = None,
) -> DataFrame:
    """A HostDown at every ``max_failures``-th failure of a host within one recovery period.

    Counts are cleared each period, and a dropped host starts again from zero.
    """
    keyed = failures.withColumn("window_start", F.window("ts", period)["start"])
    indexed = with_group_index(keyed, ["host", "window_start"], ["ts", "event_id"], "_i", hot_rows)
    return indexed.where((F.col("_i") + 1) % max_failures == 0).select(
        "host",
        "window_start",
        F.col("ts").alias("down_ts"),
        ((F.col("_i") + 1) / max_failures).cast("bigint").alias("nth"),
    )


def reconnect_schedule(downs: DataFrame, delay: float = RECONNECT_DELAY) -> DataFrame:
    """Host events with the HostUp that follows every HostDown after the delay."""
    down = downs.select("host", F.col("down_ts").alias("ts"), F.lit("down").alias("event"))
    up = downs.select("host", (F.col("down_ts") + seconds_interval(delay)).alias("ts"), F.lit("up").alias("event"))
    return down.unionByName(up)


def request_reply_fifo(
    commands: DataFrame, replies: DataFrame, live: DataFrame | None = None, hot_rows: int | None = None
) -> DataFrame:
    """The n-th reply of a connection answers its n-th command; leftovers fail with a reason.

    The join key is (conn, n), so even one connection's traffic spreads over all tasks. With
    ``live`` given, commands of connections without a live host fail at once.
    """
    order = ["ts", "event_id"]
    reachable = commands
    if live is not None:
        reachable = commands.join(live.select("conn"), "conn", "left_semi")
    cmds = with_group_index(reachable, ["conn"], order, "seq", hot_rows).select(
        "conn", "seq", F.col("event_id").alias("cmd_id"), F.col("ts").alias("cmd_ts")
    )
    answers = with_group_index(replies, ["conn"], order, "seq", hot_rows).select(
        "conn", "seq", F.col("event_id").alias("reply_id"), F.col("ts").alias("reply_ts")
    )
    answered = F.col("reply_id").isNotNull()
    matched = cmds.join(answers, ["conn", "seq"], "left").select(
        "conn",
        "seq",
        "cmd_id",
        "cmd_ts",
        "reply_id",
        "reply_ts",
        F.when(answered, "answered").otherwise("failed").alias("status"),
        F.when(~answered, "ConnectionClosed").alias("reason"),
    )
    if live is None:
        return matched
    unreachable = commands.join(live.select("conn"), "conn", "left_anti").select(
        "conn",
        F.lit(None).cast("bigint").alias("seq"),
        F.col("event_id").alias("cmd_id"),
        F.col("ts").alias("cmd_ts"),
        F.lit(None).cast("bigint").alias("reply_id"),
        F.lit(None).cast("timestamp_ntz").alias("reply_ts"),
        F.lit("failed").alias("status"),
        F.lit("NoConnectionsAvailable").alias("reason"),
    )
    return matched.unionByName(unreachable)


def active_subscriptions(log: DataFrame) -> DataFrame:
    """Keys whose last add/remove is an add: adds are idempotent, removing an absent key is a no-op."""
    last = log.groupBy("key").agg(
        F.max_by("op", F.struct("ts", "event_id")).alias("op"), F.max("ts").alias("since")
    )
    return last.where(F.col("op") == "add").select("key", "since")

"""Device sessions: state history, snapshot and message gate.

Input events have ``addr``, ``ts``, ``event_id``, ``kind`` (``new``, ``resolve``, ``reset`` or a
message kind) and ``device_id`` (null for a resolve that names no device).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import seconds_interval
from framewright.operators.ordering import HotKeys, KeyedScan, hot_keys, lookup_join

# Seconds to name a device, seconds until a reply is checked.
RESOLVE_TIMEOUT = 5.0
CHECK_DELAY = 1.0


def _state(name: str, device: Column | None = None) -> Column:
    device = F.lit(None).cast("string") if device is None else device
    return F.struct(F.lit(name).alias("state"), device.alias("device_id"))


def _here() -> Column:
    return F.struct("ts", "event_id")


def _base_change() -> Column:
    """Session change of a resolve or reset row of a known address."""
    kind = F.col("kind")
    return F.when(
        (kind == "resolve") & F.col("device_id").isNotNull(), _state("Active", F.col("device_id"))
    ).when(kind == "reset", _state("Expired"))


def _timers(events: DataFrame, timeout: float) -> DataFrame:
    """One row per address whose resolve timeout falls due within these events.

    Only timers due by the last event exist, as in a replayed stream.
    """
    first = events.where(F.col("kind") == "new")
    due = first.groupBy("addr").agg((F.min("ts") + seconds_interval(timeout)).alias("ts"))
    return due.where(F.col("ts") <= events.agg(F.max("ts")).scalar())


def session_history(
    events: DataFrame, timeout: float = RESOLVE_TIMEOUT, hot_rows: int | None = None
) -> DataFrame:
    """Session state and device after every event from an address's first ``new`` on.

    First new -> Init; resolve with a device -> Active; reset -> Expired; a timer expires the
    session unless a device is known by then. Each step is a running count or a running last change
    over one window, so one shuffle serves all.
    """
    log = events.select("addr", "ts", "event_id", "kind", "device_id").unionByName(
        _timers(events, timeout).select(
            "addr",
            "ts",
            F.lit(-1).cast("bigint").alias("event_id"),
            F.lit("timer").alias("kind"),
            F.lit(None).cast("string").alias("device_id"),
        )
    )
    log = log.withColumn("_late", (F.col("kind") == "timer").cast("int"))
    scan = KeyedScan(log, ["addr"], ["ts", "_late", "event_id"], hot_rows, events)
    w = scan.running
    last_row = F.struct("ts", "_late", "event_id")
    rows = scan.rows.withColumn("_news", F.sum((F.col("kind") == "new").cast("bigint")).over(w))
    rows = scan.carry(
        rows,
        [F.max("_news").alias("_n")],
        lambda chunks, earlier: chunks.withColumn("_news0", F.sum("_n").over(earlier)),
        {"_news0": F.lit(0).cast("bigint")},
    )
    rows = rows.withColumn("_news", F.col("_news") + F.col("_news0")).where(F.col("_news") > 0)
    change = F.when((F.col("kind") == "new") & (F.col("_news") == 1), _state("Init")).otherwise(_base_change())
    rows = rows.withColumn("_change", change)
    rows = rows.withColumn("_base", F.last("_change", True).over(w))
    none = F.lit(None).cast("struct<state:string,device_id:string>")
    rows = scan.carry(
        rows,
        [F.max_by("_base", last_row).alias("_end")],
        lambda chunks, earlier: chunks.withColumn("_base0", F.last("_end", True).over(earlier)),
        {"_base0": none},
    )
    unresolved = (F.col("kind") == "timer") & (F.coalesce("_base", "_base0")["state"] != "Active")
    rows = rows.withColumn("_change", F.when(unresolved, _state("Expired")).otherwise(F.col("_change")))
    rows = rows.withColumn("_now", F.last("_change", True).over(w))
    rows = scan.carry(
        rows,
        [F.max_by("_now", last_row).alias("_end")],
        lambda chunks, earlier: chunks.withColumn("_now0", F.last("_end", True).over(earlier)),
        {"_now0": none},
    )
    now = F.coalesce("_now", "_now0")
    return rows.select(
        "addr", "ts", "event_id", "kind", now["state"].alias("state"), now["device_id"].alias("session_device")
    )


def session_facts(
    events: DataFrame,
    timeout: float = RESOLVE_TIMEOUT,
    check_delay: float | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """What decides a session, one row per address, by map-side combined aggregations.

    ``first_new``, ``due`` (the resolve timeout), ``reply`` (first uuid reply), ``probe_ts``
    (reply + check delay; null without a delay), and the last change up to the timeout
    (``early``) and after it (``late``), counting changes up to the probe only.
    """
    firsts = events.where(F.col("kind") == "new").groupBy("addr").agg(F.min(_here()).alias("first_new"))
    resolves = events.where((F.col("kind") == "resolve") & F.col("device_id").isNotNull())
    replies = (
        lookup_join(resolves, firsts, "addr", hot=hot)
        .where(_here() > F.col("first_new"))
        .groupBy("addr")
        .agg(F.min(_here()).alias("reply"))
    )
    probe = F.lit(None).cast("timestamp_ntz")
    if check_delay is not None:
        probe = F.col("reply.ts") + seconds_interval(check_delay)
    times = (
        firsts.join(replies, "addr", "left")
        .withColumn("due", F.col("first_new.ts") + seconds_interval(timeout))
        .withColumn("probe_ts", probe)
    )
    changes = events.withColumn("_change", _base_change()).where(F.col("_change").isNotNull())
    seen = lookup_join(changes, times, "addr", hot=hot).where(
        (_here() > F.col("first_new")) & (F.col("probe_ts").isNull() | (F.col("ts") <= F.col("probe_ts")))
    )
    before = F.col("ts") <= F.col("due")
    ends = seen.groupBy("addr").agg(
        F.max_by(F.when(before, F.col("_change")), F.when(before, _here())).alias("early"),
        F.max_by(F.when(~before, F.col("_change")), F.when(~before, _here())).alias("late"),
    )
    return times.join(ends, "addr", "left")


def _state_at(time: Column) -> Column:
    """Session state of :func:`session_facts` at a time no earlier than its changes."""
    early = F.coalesce("early", _state("Init"))
    return (
        F.when(F.col("late").isNotNull(), F.col("late"))
        .when((F.col("due") <= time) & (early["state"] != "Active"), _state("Expired"))
        .otherwise(early)
    )


def session_snapshot(
    events: DataFrame, probes: DataFrame, timeout: float = RESOLVE_TIMEOUT, hot_rows: int | None = None
) -> DataFrame:
    """Current state for each probed address; an unknown address counts as Expired."""
    facts = session_facts(events, timeout, None, hot_keys(events, ["addr"], hot_rows))
    now = facts.withColumn("_now", events.agg(F.max("ts")).scalar()).withColumn("_state", _state_at(F.col("_now")))
    states = now.select("addr", "_state.state", F.col("_state.device_id").alias("session_device"))
    return probes.join(states, "addr", "left").withColumn("state", F.coalesce("state", F.lit("Expired")))


def judge_messages(events: DataFrame, facts: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Messages (everything but ``new`` and ``reset``) with ``passed`` and ``drop_reason``."""
    messages = events.where(~F.col("kind").isin("new", "reset"))
    gated = lookup_join(messages, facts, "addr", hot=hot).where(_here() > F.col("first_new"))
    reply = F.col("reply")
    waiting = reply.isNull() | (_here() < reply)
    malformed = (F.col("kind") == "resolve") & F.col("device_id").isNull()
    reason = (
        F.when(waiting & malformed, "malformed uuid")
        .when(waiting, "initialising")
        .when(_here() == reply, "consumed")
        .when(F.col("ts") <= F.col("probe_ts"), "checking")
        .when(_state_at(F.col("probe_ts"))["state"] != "Active", "expired")
    )
    return gated.withColumn("drop_reason", reason).select(
        "addr", "ts", "event_id", "kind", F.col("drop_reason").isNull().alias("passed"), "drop_reason"
    )


def gate_open(facts: DataFrame) -> DataFrame:
    """Addresses whose gate opens, with the time after which their messages pass (``open_ts``)."""
    active = _state_at(F.col("probe_ts"))["state"] == "Active"
    return facts.where(F.col("reply").isNotNull() & active).select("addr", F.col("probe_ts").alias("open_ts"))


def session_gate(
    events: DataFrame,
    timeout: float = RESOLVE_TIMEOUT,
    check_delay: float = CHECK_DELAY,
    hot_rows: int | None = None,
) -> DataFrame:
    """Which messages pass an address's gate.

    Until the first uuid reply a connection is initialising, then checking for ``check_delay``;
    the session state at that moment decides once for everything later.
    """
    hot = hot_keys(events, ["addr"], hot_rows)
    return judge_messages(events, session_facts(events, timeout, check_delay, hot), hot)

"""Queries over sessions and hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import hosts as ho
from framewright.operators import sessions as se
from framewright.operators.messages import SERVER_UUID, encode_messages
from framewright.operators.serving import serve_messages
from framewright.plans import fixtures as fx
from framewright.plans.fixtures import with_views
from framewright.plans.message_queries import CHUNK_STREAMS_SQL
from framewright.plans.registry import query

HISTORY_CTES = """
    WITH bounds AS (SELECT addr, min(ts) AS first_ts FROM sess WHERE kind = 'new' GROUP BY addr),
    timers AS (
      SELECT addr, first_ts + INTERVAL 6 HOUR AS ts, -1 AS event_id, 'timer' AS kind, NULL AS device_id, 1 AS late
      FROM bounds WHERE first_ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM sess)),
    log AS (
      SELECT addr, ts, event_id, kind, device_id, 0 AS late FROM sess
      UNION ALL SELECT addr, ts, event_id, kind, device_id, late FROM timers),
    known AS (
      SELECT *, sum(CASE WHEN kind = 'new' THEN 1 ELSE 0 END) OVER w AS news FROM log
      WINDOW w AS (PARTITION BY addr ORDER BY ts, late, event_id ROWS UNBOUNDED PRECEDING)
      QUALIFY news > 0),
    changed AS (
      SELECT *, CASE WHEN kind = 'new' AND news = 1 THEN 'Init'
        WHEN kind = 'resolve' AND device_id IS NOT NULL THEN 'Active' WHEN kind = 'reset' THEN 'Expired' END AS change
      FROM known),
    based AS (
      SELECT *, last_value(change IGNORE NULLS) OVER (
        PARTITION BY addr ORDER BY ts, late, event_id ROWS UNBOUNDED PRECEDING) AS base FROM changed),
    timed AS (
      SELECT *, CASE WHEN kind = 'timer' AND base <> 'Active' THEN 'Expired' ELSE change END AS change2 FROM based),
    history AS (
      SELECT addr, ts, event_id, kind, late, last_value(change2 IGNORE NULLS) OVER w AS state,
        nullif(last_value(CASE WHEN change2 = 'Active' THEN device_id WHEN change2 IS NOT NULL THEN '' END
          IGNORE NULLS) OVER w, '') AS session_device
      FROM timed WINDOW w AS (PARTITION BY addr ORDER BY ts, late, event_id ROWS UNBOUNDED PRECEDING))
"""

HISTORY_SQL = with_views(
    HISTORY_CTES + "SELECT addr, ts, CAST(event_id AS BIGINT) AS event_id, kind, state, session_device FROM history",
    "sess",
)


@query("session_history", HISTORY_SQL)
def session_history(spark, sf_dir):
    return se.session_history(fx.session_events(spark, sf_dir), fx.SESSION_TIMEOUT)


@query(
    "session_snapshot",
    with_views(
        HISTORY_CTES
        + """, latest AS (
          SELECT addr, arg_max(state, (ts, late, event_id)) AS state,
            arg_max_null(session_device, (ts, late, event_id)) AS session_device
          FROM history GROUP BY addr)
        SELECT c_custkey AS addr, coalesce(state, 'Expired') AS state, session_device
        FROM customer LEFT JOIN latest ON addr = c_custkey""",
        "sess",
    ),
)
def session_snapshot(spark, sf_dir):
    probes = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("addr"))
    return se.session_snapshot(fx.session_events(spark, sf_dir), probes, fx.SESSION_TIMEOUT)


GATE_SQL = with_views(
    HISTORY_CTES
    + """, firsts AS (SELECT addr, min((ts, event_id)) AS first_new FROM sess WHERE kind = 'new' GROUP BY addr),
    answered AS (
      SELECT s.addr, min((s.ts, s.event_id)) AS reply, min(s.ts) AS r, min(s.ts) + INTERVAL 1 HOUR AS probe
      FROM sess s JOIN firsts f ON s.addr = f.addr
      WHERE kind = 'resolve' AND device_id IS NOT NULL AND (s.ts, s.event_id) > f.first_new GROUP BY s.addr),
    verdicts AS (
      SELECT a.addr, arg_max(h.state, (h.ts, h.late, h.event_id)) AS verdict
      FROM answered a JOIN history h ON a.addr = h.addr AND h.ts <= a.probe GROUP BY a.addr),
    judged AS (
      SELECT s.addr, s.ts, s.event_id, s.kind, CASE
        WHEN (a.reply IS NULL OR (s.ts, s.event_id) < a.reply) AND s.kind = 'resolve' AND s.device_id IS NULL
          THEN 'malformed uuid'
        WHEN a.reply IS NULL OR (s.ts, s.event_id) < a.reply THEN 'initialising'
        WHEN (s.ts, s.event_id) = a.reply THEN 'consumed'
        WHEN s.ts <= a.probe THEN 'checking' WHEN v.verdict <> 'Active' THEN 'expired' END AS drop_reason
      FROM sess s JOIN firsts f ON s.addr = f.addr LEFT JOIN answered a ON s.addr = a.addr
      LEFT JOIN verdicts v ON s.addr = v.addr
      WHERE s.kind NOT IN ('new', 'reset') AND (s.ts, s.event_id) > f.first_new)
    SELECT addr, ts, event_id, kind, drop_reason IS NULL AS passed, drop_reason FROM judged""",
    "sess",
)


@query("session_gate", GATE_SQL)
def session_gate(spark, sf_dir):
    return se.session_gate(fx.session_events(spark, sf_dir), fx.SESSION_TIMEOUT, fx.CHECK_DELAY)


BREAKER_CTES = """
    WITH numbered AS (
      SELECT *, date_trunc('day', ts) AS window_start, row_number() OVER (
        PARTITION BY host, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM host_ev),
    downs AS (
      SELECT host, window_start, ts AS down_ts, CAST(rn // 6 AS BIGINT) AS nth FROM numbered WHERE rn % 6 = 0)
"""


def _downs(spark, sf_dir):
    return ho.host_failure_breaker(fx.host_failures(spark, sf_dir), fx.BREAKER_MAX, fx.BREAKER_WINDOW)


@query("host_failure_breaker", with_views(BREAKER_CTES + "SELECT * FROM downs", "host_ev"))
def host_failure_breaker(spark, sf_dir):
    return _downs(spark, sf_dir)


@query(
    "reconnect_schedule",
    with_views(
        BREAKER_CTES
        + """SELECT host, down_ts AS ts, 'down' AS event FROM downs
        UNION ALL SELECT host, down_ts + INTERVAL 2 HOUR AS ts, 'up' AS event FROM downs""",
        "host_ev",
    ),
)
def reconnect_schedule(spark, sf_dir):
    return ho.reconnect_schedule(_downs(spark, sf_dir), fx.RECONNECT)


FIFO_SQL = with_views(
    """WITH c AS (SELECT conn, event_id AS cmd_id, ts AS cmd_ts,
        row_number() OVER (PARTITION BY conn ORDER BY ts, event_id) - 1 AS seq FROM cmds WHERE conn % 10 <> 0),
      r AS (SELECT conn, event_id AS reply_id, ts AS reply_ts,
        row_number() OVER (PARTITION BY conn ORDER BY ts, event_id) - 1 AS seq FROM replies)
    SELECT c.conn, CAST(c.seq AS BIGINT) AS seq, cmd_id, cmd_ts, coalesce(reply_id, -1) AS reply_id, reply_ts,
      CASE WHEN reply_id IS NULL THEN 'failed' ELSE 'answered' END AS status,
      CASE WHEN reply_id IS NULL THEN 'ConnectionClosed' END AS reason
    FROM c LEFT JOIN r ON c.conn = r.conn AND c.seq = r.seq
    UNION ALL SELECT conn, -1, event_id, ts, -1, NULL, 'failed', 'NoConnectionsAvailable'
    FROM cmds WHERE conn % 10 = 0""",
    "cmds",
    "replies",
)


@query("request_reply_fifo", FIFO_SQL)
def request_reply_fifo(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    matched = ho.request_reply_fifo(fx.commands_view(events), fx.replies_view(events), fx.live_conns_view(events))
    return known_ids(matched)


def known_ids(matched):
    """Missing numbers as -1."""
    return matched.withColumns({c: F.coalesce(c, F.lit(-1).cast("bigint")) for c in ("seq", "reply_id")})


@query(
    "active_subscriptions",
    with_views(
        """SELECT key, max(ts) AS since FROM subs GROUP BY key HAVING arg_max(op, (ts, event_id)) = 'add'""", "subs"
    ),
)
def active_subscriptions(spark, sf_dir):
    return ho.active_subscriptions(fx.subscriptions(spark, sf_dir))


SERVE_SQL = with_views(
    HISTORY_CTES
    + """, firsts AS (SELECT addr, min((ts, event_id)) AS first_new FROM sess WHERE kind = 'new' GROUP BY addr),
    answered AS (
      SELECT s.addr, min(s.ts) + INTERVAL 1 HOUR AS probe FROM sess s JOIN firsts f ON s.addr = f.addr
      WHERE kind = 'resolve' AND device_id IS NOT NULL AND (s.ts, s.event_id) > f.first_new GROUP BY s.addr),
    opened AS (
      SELECT a.addr, a.probe FROM answered a JOIN history h ON a.addr = h.addr AND h.ts <= a.probe
      GROUP BY a.addr, a.probe HAVING arg_max(h.state, (h.ts, h.late, h.event_id)) = 'Active'),
    chunks AS (
      SELECT conn, ts, event_id, payload, tag, cmd, CASE
        WHEN tag = 3 AND length(payload) > 0 THEN 'C' WHEN tag = 3 THEN 'T' WHEN tag = 1 AND cmd = 2 THEN 'O'
        WHEN tag IN (4, 10) OR (tag = 1 AND cmd IN (3, 4, 5, 99)) THEN 'X' END AS role
      FROM msgs JOIN opened ON conn = addr AND ts > probe
      WHERE NOT (tag = 2 OR (tag = 1 AND cmd = 1))),"""
    + CHUNK_STREAMS_SQL.strip().removeprefix("WITH")
    + f""", ends AS (
      SELECT conn, stream, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM segmented GROUP BY conn, stream),
    replies AS (
      SELECT conn, ts, event_id, CASE cmd WHEN 3 THEN payload WHEN 4 THEN '{SERVER_UUID}' ELSE 'PONG' END AS reply
      FROM chunks WHERE tag = 1 AND cmd IN (3, 4, 99)
        AND NOT EXISTS (SELECT 1 FROM segmented g WHERE g.conn = chunks.conn AND g.event_id = chunks.event_id)
      UNION ALL SELECT s.conn, e.ts, e.event_id, CAST(total AS VARCHAR) FROM streams s
      JOIN ends e ON s.conn = e.conn AND s.stream = e.stream WHERE opened_by = 'O' AND status = 'completed')
    SELECT conn, ts, event_id, reply, '00000002' || hex(encode(reply)) AS wire FROM replies""",
    "sess",
    "msgs",
)


@query("serve_messages", SERVE_SQL)
def serve(spark, sf_dir):
    """Messages of open sessions in, encoded replies out."""
    wire = encode_messages(fx.messages(spark, sf_dir)).select("conn", "ts", "event_id", "wire")
    out = serve_messages(wire, fx.session_events(spark, sf_dir), fx.SESSION_TIMEOUT, fx.CHECK_DELAY)
    return out.select("conn", "ts", "event_id", F.col("payload").alias("reply"), F.hex("wire").alias("wire"))

"""Queries over message logs: routing, replies, merging, substreams, bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import messages as ms
from framewright.operators.framing import split_frames as split_frames_of
from framewright.operators.ordering import with_global_index
from framewright.plans import fixtures as fx
from framewright.plans.fixtures import with_views
from framewright.plans.registry import query


def _routes_sql(frames: str, replies: str, commands: str) -> str:
    return with_views(
        f"""SELECT event_id, conn, tag, CASE
          WHEN tag = 3 THEN CASE WHEN length(payload) > 0 THEN 'ConsumeStreamChunk' ELSE 'EndStream' END
          WHEN tag = 1 THEN {commands} WHEN tag = 2 THEN '{replies}' WHEN tag = 4 THEN 'AcceptError'
          WHEN tag = 10 THEN '{frames}' ELSE 'Ignore' END AS action FROM msgs""",
        "msgs",
    )


_SERVER_COMMANDS = """CASE WHEN cmd IN (3, 4, 99) THEN 'Signal' WHEN cmd = 2 THEN 'ConsumeStream'
  WHEN cmd = 5 THEN 'AcceptSignal' ELSE 'Ignore' END"""
_CLIENT_COMMANDS = "CASE WHEN cmd = 4 THEN 'Signal' WHEN cmd IN (3, 99) THEN 'Ignore' ELSE 'invalid' END"


@query("route_messages_basic", _routes_sql("Ignore", "AcceptSignal", _SERVER_COMMANDS))
def route_messages_basic(spark, sf_dir):
    return ms.route_basic(fx.messages(spark, sf_dir)).select("event_id", "conn", "tag", "action")


@query("route_messages_extended", _routes_sql("AcceptSignal", "Ignore", _SERVER_COMMANDS))
def route_messages_extended(spark, sf_dir):
    return ms.route_extended(fx.messages(spark, sf_dir)).select("event_id", "conn", "tag", "action")


@query("route_messages_client", _routes_sql("Signal", "AcceptSignal", _CLIENT_COMMANDS))
def route_messages_client(spark, sf_dir):
    return ms.route_client(fx.messages(spark, sf_dir)).select("event_id", "conn", "tag", "action")


@query(
    "command_replies",
    with_views(
        f"""SELECT event_id, conn, cmd, CASE cmd WHEN 3 THEN payload WHEN 4 THEN '{ms.SERVER_UUID}' WHEN 5 THEN
          (SELECT '{{' || string_agg('"' || id || '":"' || display_name || '"', ',' ORDER BY id) || '}}' FROM label_map)
          ELSE 'PONG' END AS reply FROM msgs WHERE tag = 1 AND cmd IN (3, 4, 5, 99)""",
        "msgs",
        "label_map",
    ),
)
def command_replies(spark, sf_dir):
    replies = ms.command_replies(fx.messages(spark, sf_dir), labels=fx.label_map(spark, sf_dir))
    return replies.select("event_id", "conn", "cmd", "reply")


KINDS = ("signup", "purchase", "click", "view", "error")


def _typed(spark, sf_dir, kind):
    events = fx.table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return events.select("event_id", "ts", "user_id", "event_type")


@query(
    "merge_streams",
    "SELECT event_id, ts, user_id, event_type FROM events",
)
def merge_streams(spark, sf_dir):
    return ms.merge_streams(*[_typed(spark, sf_dir, k) for k in KINDS])


@query(
    "merge_streams_eager",
    """SELECT event_id, ts, user_id, event_type FROM events
    WHERE ts <= (SELECT min(m) FROM (SELECT max(ts) AS m FROM events GROUP BY event_type))""",
)
def merge_streams_eager(spark, sf_dir):
    return ms.merge_streams_eager(*[_typed(spark, sf_dir, k) for k in KINDS])


@query(
    "concat_streams",
    """SELECT event_id, ts, ordinal, CAST(row_number() OVER (ORDER BY ordinal, ts, event_id) - 1 AS BIGINT) AS idx
    FROM (SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2
            WHEN 'view' THEN 3 ELSE 4 END AS ordinal FROM events)""",
)
def concat_streams(spark, sf_dir):
    joined = ms.concat_streams(*[_typed(spark, sf_dir, k) for k in KINDS])
    return with_global_index(joined, ["ordinal", "ts", "event_id"]).select("event_id", "ts", "ordinal", "idx")


@query("label_map_reply", with_views("SELECT id, display_name FROM label_map", "label_map"))
def label_map_reply(spark, sf_dir):
    reply = ms.label_map_reply(fx.label_map(spark, sf_dir))
    return reply.select(F.explode("labels").alias("id", "display_name"))


CHUNK_STREAMS_SQL = """
    WITH marked AS (
      SELECT *, sum(CASE WHEN role <> 'O' THEN 1 ELSE 0 END) OVER w AS g FROM chunks
      WINDOW w AS (PARTITION BY conn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    stated AS (
      SELECT *, CAST((max(CASE WHEN role = 'C' THEN 1 ELSE 0 END) OVER (PARTITION BY conn, g)
        + sum(CASE WHEN role = 'O' THEN 1 ELSE 0 END) OVER (
          PARTITION BY conn, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) % 2 AS INTEGER) AS open
      FROM marked),
    stepped AS (
      SELECT *, coalesce(lag(open) OVER (PARTITION BY conn ORDER BY ts, event_id), 0) AS prev FROM stated),
    segmented AS (
      SELECT *, CAST(sum(CASE WHEN prev = 0 AND open = 1 THEN 1 ELSE 0 END) OVER (
        PARTITION BY conn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stream
      FROM stepped QUALIFY prev = 1 OR open = 1),
    streams AS (
      SELECT conn, stream, arg_min(role, (ts, event_id)) AS opened_by, CAST(count(*) AS BIGINT) AS n_rows,
        CASE WHEN arg_max(open, (ts, event_id)) = 1 THEN 'unfinished'
             WHEN arg_max(role, (ts, event_id)) = 'T' THEN 'completed' ELSE 'aborted' END AS status,
        CAST(sum(CASE WHEN open = 1 OR role = 'T' THEN length(payload) ELSE 0 END) AS BIGINT) AS total
      FROM segmented GROUP BY conn, stream)
"""


@query(
    "chunk_stream_ids",
    with_views(CHUNK_STREAMS_SQL + "SELECT conn, event_id, role, stream, open FROM segmented", "chunks"),
)
def chunk_stream_ids(spark, sf_dir):
    return ms.chunk_stream_ids(ms.chunk_rows(fx.chunk_log(spark, sf_dir))).select("conn", "event_id", "role", "stream", "open")


@query(
    "chunk_streams",
    with_views(CHUNK_STREAMS_SQL + "SELECT conn, stream, opened_by, n_rows, status, total FROM streams", "chunks"),
)
def chunk_streams(spark, sf_dir):
    streams = ms.chunk_streams(ms.chunk_stream_ids(ms.chunk_rows(fx.chunk_log(spark, sf_dir))))
    return streams.select("conn", "stream", "opened_by", "n_rows", "status", "total")


CHUNK_TOTAL_SQL = with_views(
    CHUNK_STREAMS_SQL
    + """SELECT conn, stream, total, CAST(total AS VARCHAR) AS reply FROM streams
    WHERE opened_by = 'O' AND status = 'completed'""",
    "chunks",
)


@query("chunk_stream_total", CHUNK_TOTAL_SQL)
def chunk_stream_total(spark, sf_dir):
    return ms.chunk_stream_total(fx.chunk_log(spark, sf_dir))


@query(
    "encode_messages",
    with_views(
        """SELECT event_id, printf('%08X', tag) || CASE tag
          WHEN 1 THEN printf('%08X', cmd) || hex(encode(payload))
          WHEN 10 THEN upper(replace(client_uuid, '-', '')) || hex(encode(body))
          ELSE hex(encode(payload)) END AS wire_hex FROM msgs""",
        "msgs",
    ),
)
def encode_messages(spark, sf_dir):
    return ms.encode_messages(fx.messages(spark, sf_dir)).select("event_id", F.hex("wire").alias("wire_hex"))


@query(
    "decode_messages",
    with_views(
        """SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 7 ELSE tag END AS tag,
          CASE WHEN event_id % 97 = 0 THEN 'unknown tag' END AS error,
          coalesce(CASE WHEN event_id % 97 <> 0 THEN cmd END, -1) AS cmd,
          CASE WHEN event_id % 97 <> 0 THEN payload END AS payload,
          CASE WHEN event_id % 97 <> 0 THEN client_uuid END AS client_uuid,
          CASE WHEN event_id % 97 <> 0 THEN body END AS body FROM msgs""",
        "msgs",
    ),
)
def decode_messages(spark, sf_dir):
    """Round trip, with an unknown tag in some messages."""
    wire = ms.encode_messages(fx.messages(spark, sf_dir))
    spoiled = F.concat(F.lit(b"\x00\x00\x00\x07"), F.substr(F.col("wire"), F.lit(5)))
    broken = wire.select("event_id", F.when(F.col("event_id") % 97 == 0, spoiled).otherwise(F.col("wire")).alias("wire"))
    cmd = F.coalesce("cmd", F.lit(-1)).alias("cmd")
    return ms.decode_messages(broken).select("event_id", "tag", "error", cmd, "payload", "client_uuid", "body")


@query(
    "split_frames",
    with_views(
        """SELECT conn, CAST(row_number() OVER (PARTITION BY conn ORDER BY ts, event_id) - 1 AS BIGINT) AS msg,
          tag, payload, CAST(NULL AS VARCHAR) AS error FROM msgs""",
        "msgs",
    ),
)
def split_frames(spark, sf_dir):
    """Frame every message, cut the bytes at unrelated places, split and decode them again."""
    framed = ms.frame_bytes(ms.encode_messages(fx.messages(spark, sf_dir)))
    cut = (F.col("event_id") % 11).cast("int") + 1
    pieces = framed.select(
        "conn",
        "ts",
        "event_id",
        F.posexplode(
            F.array(
                F.substring(F.col("data"), F.lit(1), cut),
                F.substr(F.col("data"), cut + 1),
            )
        ).alias("piece", "data"),
    )
    messages = split_frames_of(pieces, ("ts", "event_id", "piece"))
    decoded = ms.decode_messages(messages.withColumnRenamed("error", "split_error"))
    return decoded.select("conn", "msg", "tag", "payload", F.coalesce("split_error", "error").alias("error"))

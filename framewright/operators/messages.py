"""Message logs: routing, replies, merging, chunk substreams, wire bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import be_int32, read_be_int32, utf16_length, uuid_text
from framewright.operators.ordering import KeyedScan

# Fixed values of the message protocol.
TAG_COMMAND, TAG_REPLY, TAG_CHUNK, TAG_ERROR, TAG_FRAMES, TAG_LABELS = 1, 2, 3, 4, 10, 11
SOCKET_FRAMES, TOTAL_CHUNK_SIZE, ECHO, UUID, LABEL_MAP, CHECK_PING = 1, 2, 3, 4, 5, 99
SERVER_TAGS = (1, 2, 3, 4, 10)
CLIENT_TAGS = (1, 2, 3, 4, 11)
SERVER_UUID = "ef52e009-9b9c-4dfd-8e98-af33d900d431"
MAX_MESSAGE = 4 << 20


def _chunk_action(payload: Column) -> Column:
    return F.when(F.length(payload) > 0, "ConsumeStreamChunk").otherwise("EndStream")


def _command_action(cmd: Column) -> Column:
    return (
        F.when(cmd.isin(ECHO, UUID, CHECK_PING), "Signal")
        .when(cmd == TOTAL_CHUNK_SIZE, "ConsumeStream")
        .when(cmd == LABEL_MAP, "AcceptSignal")
        .otherwise("Ignore")
    )


def route_basic(messages: DataFrame) -> DataFrame:
    """Server rules without frames: replies are accepted, frame sequences ignored."""
    tag = F.col("tag")
    return messages.withColumn(
        "action",
        F.when(tag == TAG_CHUNK, _chunk_action(F.col("payload")))
        .when(tag == TAG_COMMAND, _command_action(F.col("cmd")))
        .when(tag == TAG_REPLY, "AcceptSignal")
        .when(tag == TAG_ERROR, "AcceptError")
        .otherwise("Ignore"),
    )


def route_extended(messages: DataFrame) -> DataFrame:
    """Server rules with frames: frame sequences are accepted, replies ignored."""
    tag = F.col("tag")
    return messages.withColumn(
        "action",
        F.when(tag == TAG_CHUNK, _chunk_action(F.col("payload")))
        .when(tag == TAG_COMMAND, _command_action(F.col("cmd")))
        .when(tag == TAG_FRAMES, "AcceptSignal")
        .when(tag == TAG_ERROR, "AcceptError")
        .otherwise("Ignore"),
    )


def route_client(messages: DataFrame) -> DataFrame:
    """Client rules; a command code the client does not know is marked ``invalid``."""
    tag, cmd = F.col("tag"), F.col("cmd")
    command = (
        F.when(cmd == UUID, "Signal").when(cmd.isin(ECHO, CHECK_PING), "Ignore").otherwise("invalid")
    )
    return messages.withColumn(
        "action",
        F.when(tag == TAG_FRAMES, "Signal")
        .when(tag == TAG_CHUNK, _chunk_action(F.col("payload")))
        .when(tag == TAG_ERROR, "AcceptError")
        .when(tag == TAG_REPLY, "AcceptSignal")
        .when(tag == TAG_COMMAND, command)
        .otherwise("Ignore"),
    )


def command_replies(
    messages: DataFrame, server_uuid: str = SERVER_UUID, labels: DataFrame | None = None
) -> DataFrame:
    """Immediate replies of single commands; commands without one are dropped.

    With ``labels`` a request for the label map is answered by the map as JSON text. The reply to a size
    request comes when its substream completes, see :func:`size_replies`.
    """
    cmd, answered = F.col("cmd"), [ECHO, UUID, CHECK_PING]
    reply = F.when(cmd == ECHO, F.col("payload")).when(cmd == UUID, server_uuid).when(cmd == CHECK_PING, "PONG")
    if labels is not None:
        answered.append(LABEL_MAP)
        reply = reply.when(cmd == LABEL_MAP, label_map_reply(labels).select(F.to_json("labels")).scalar())
    return (
        messages.where((F.col("tag") == TAG_COMMAND) & cmd.isin(*answered))
        .withColumn("reply", reply)
        .where(F.col("reply").isNotNull())
    )


def merge_streams(*streams: DataFrame) -> DataFrame:
    """Multiset union."""
    merged = streams[0]
    for other in streams[1:]:
        merged = merged.unionByName(other)
    return merged


def merge_streams_eager(*streams: DataFrame) -> DataFrame:
    """Union that ends when the first input ends: rows up to the earliest last timestamp; none if an input is empty."""
    ends = merge_streams(*[s.agg(F.max("ts").alias("ts")) for s in streams])
    end = F.when(F.count("ts") == len(streams), F.min("ts"))
    return merge_streams(*streams).where(F.col("ts") <= ends.agg(end).scalar())


def concat_streams(*streams: DataFrame) -> DataFrame:
    """Ordered concatenation: ``ordinal`` is the input a row came from."""
    return merge_streams(*[s.withColumn("ordinal", F.lit(i)) for i, s in enumerate(streams)])


def label_map_reply(labels: DataFrame) -> DataFrame:
    """A label dimension as one map value, the payload of one message, and ``error``.

    A message is bounded. A map whose JSON text with its tag does not fit one is not gathered: ``labels`` is null and
    ``error`` says so, as for a message that is too long on the wire.
    """
    entry = F.octet_length(F.to_json(F.create_map("id", "display_name")))
    size = labels.agg(F.sum(entry - 1)).first()[0] or 1
    if size + 1 + 4 > MAX_MESSAGE:
        return labels.agg(F.lit(None).cast("map<int,string>").alias("labels"), F.lit("too long").alias("error"))
    entries = F.sort_array(F.collect_list(F.struct("id", "display_name")))
    return labels.agg(F.map_from_entries(entries).alias("labels"), F.lit(None).cast("string").alias("error"))


def chunk_roles(messages: DataFrame) -> DataFrame:
    """Role of each routed message for substreams: open, chunk, end, other; ignored ones leave."""
    action = F.col("action")
    heard = messages.where(action != "Ignore")
    role = (
        F.when(action == "ConsumeStream", "O")
        .when(action == "ConsumeStreamChunk", "C")
        .when(action == "EndStream", "T")
        .otherwise("X")
    )
    return heard.withColumn("role", role)


def chunk_rows(log: DataFrame, *keep: str) -> DataFrame:
    """A role-marked log in the form substreams are computed on, with the columns to ``keep``.

    ``units``, ``n_rows`` and ``opened_by`` are what the row adds to its stream; the ``_in``
    columns are only set on rows that stand for an earlier part of the log.
    """
    return log.select(
        "conn",
        "ts",
        "event_id",
        "role",
        utf16_length(F.col("payload")).cast("bigint").alias("units"),
        F.lit(1).cast("bigint").alias("n_rows"),
        F.col("role").alias("opened_by"),
        F.lit(None).cast("int").alias("open_in"),
        F.lit(None).cast("bigint").alias("streams_in"),
        *keep,
    )


def segment_chunks(
    rows: DataFrame, hot_rows: int | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Mark each row of an ordered log (see :func:`chunk_rows`) with its substream.

    A chunk (C) always leaves a stream open, an end (T) or another message (X) always leaves none
    open, an opener (O) opens when idle and aborts when open. So the open/closed state is the last
    non-O effect plus the parity of openers since, and stream ids count the 0 -> 1 steps.
    ``open`` is the state after the row; ``stream`` is null for rows outside any stream.
    """
    order = ["ts", "event_id"]
    scan = KeyedScan(rows, ["conn"], order, hot_rows, counted)
    w = scan.running
    role = F.col("role")
    forced = F.when(role == "C", 1).when(role == "S", F.col("open_in")).when(role != "O", 0)
    marked = scan.rows.withColumn("_forced", forced)
    marked = marked.withColumn("_openers", F.sum((role == "O").cast("bigint")).over(w))
    at_forced = F.when(F.col("_forced").isNotNull(), F.col("_openers"))
    marked = marked.withColumn("_last_forced", F.last("_forced", True).over(w))
    marked = marked.withColumn("_since", F.col("_openers") - F.coalesce(F.last(at_forced, True).over(w), F.lit(0)))

    def entry_state(chunks, earlier):
        total = chunks.withColumn("_sum0", F.coalesce(F.sum("_since_end").over(earlier), F.lit(0)))
        at = F.when(F.col("_forced_end").isNotNull(), F.col("_sum0"))
        base = F.coalesce(F.last("_forced_end", True).over(earlier), F.lit(0))
        since = F.col("_sum0") - F.coalesce(F.last(at, True).over(earlier), F.lit(0))
        return total.withColumn("_entry", ((base + since) % 2).cast("int"))

    last_row = F.struct(*order)
    marked = scan.carry(
        marked,
        [
            F.max_by("_last_forced", last_row).alias("_forced_end"),
            F.max_by("_since", last_row).alias("_since_end"),
        ],
        entry_state,
        {"_entry": F.lit(0)},
    )
    state = ((F.coalesce("_last_forced", "_entry") + F.col("_since")) % 2).cast("int")
    marked = marked.withColumn("open", state)
    marked = marked.withColumn("_prev", F.coalesce(F.lag("open").over(scan.window), F.col("_entry")))
    starts = ((F.col("_prev") == 0) & (F.col("open") == 1)).cast("bigint")
    marked = marked.withColumn("_start", F.coalesce("streams_in", starts))
    marked = marked.withColumn("_id", F.sum("_start").over(w))
    marked = scan.carry(
        marked,
        [F.sum("_start").alias("_starts")],
        lambda chunks, earlier: chunks.withColumn("_id0", F.sum("_starts").over(earlier)),
        {"_id0": F.lit(0).cast("bigint")},
    )
    inside = (F.col("open") == 1) | (F.col("_prev") == 1)
    return marked.select(*rows.columns, F.when(inside, F.col("_id") + F.col("_id0")).alias("stream"), "open")


def chunk_stream_ids(rows: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Rows of an ordered log that belong to a substream, with its id."""
    return segment_chunks(rows, hot_rows).where(F.col("stream").isNotNull())


def chunk_streams(segmented: DataFrame) -> DataFrame:
    """One row per substream: how it opened, how it ended, rows and payload length."""
    order = F.struct("ts", "event_id")
    # the row that ends or aborts a stream is not part of it; the opener is
    counted = F.when(F.col("open") == 1, F.col("units")).otherwise(0)
    streams = segmented.groupBy("conn", "stream").agg(
        F.min_by("opened_by", order).alias("opened_by"),
        F.max_by(F.struct("role", "open", "ts", "event_id"), order).alias("_last"),
        F.sum("n_rows").alias("n_rows"),
        F.sum(counted).alias("total"),
    )
    status = (
        F.when(F.col("_last.open") == 1, "unfinished")
        .when(F.col("_last.role") == "T", "completed")
        .otherwise("aborted")
    )
    return streams.select(
        "conn", "stream", "opened_by", "n_rows", "total", status.alias("status"), "_last.ts", "_last.event_id"
    )


def size_replies(streams: DataFrame) -> DataFrame:
    """Replies to size commands: total payload of streams an opener began and an end completed."""
    return streams.where((F.col("opened_by") == "O") & (F.col("status") == "completed")).withColumn(
        "reply", F.col("total").cast("string")
    )


def chunk_stream_total(log: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Size replies of a role-marked log (``conn``, ``ts``, ``event_id``, ``role``, ``payload``)."""
    streams = chunk_streams(chunk_stream_ids(chunk_rows(log), hot_rows))
    return size_replies(streams).select("conn", "stream", "total", "reply")


def _optional(df: DataFrame, name: str, type_name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(type_name)


def encode_messages(messages: DataFrame) -> DataFrame:
    """Message rows to bytes: big-endian tag, then the body of that tag.

    Frames and label maps travel as JSON text in ``body``.
    """
    tag = F.col("tag")
    text = F.encode(F.col("payload"), "UTF-8")
    body = F.encode(_optional(messages, "body", "string"), "UTF-8")
    uuid_bytes = F.unhex(F.replace(_optional(messages, "client_uuid", "string"), F.lit("-"), F.lit("")))
    data = (
        F.when(tag == TAG_COMMAND, F.concat(be_int32(F.col("cmd")), text))
        .when(tag.isin(TAG_REPLY, TAG_CHUNK, TAG_ERROR), text)
        .when(tag == TAG_FRAMES, F.concat(uuid_bytes, body))
        .when(tag == TAG_LABELS, body)
        .otherwise(F.lit(b""))
    )
    return messages.withColumn("wire", F.concat(be_int32(tag), data))


def decode_messages(wire: DataFrame, tags: tuple[int, ...] = SERVER_TAGS, data: str = "wire") -> DataFrame:
    """Bytes to message rows; an unknown tag, a short body or text that is no UTF-8 is named in ``error``.

    The tag leaves through ``inline``, so every later use reads a column instead of repeating its
    extraction, also in filters pushed down from further up.
    """
    raw, tag = F.col(data), F.col("tag")
    size = F.octet_length(raw)

    def text_from(position: int) -> Column:
        return F.substr(raw, F.lit(position)).cast("string")

    tagged = wire.select("*", F.inline(F.array(F.struct(read_be_int32(raw, 1).alias("tag")))))
    short = tag.isNull() | ((tag == TAG_COMMAND) & (size < 8)) | ((tag == TAG_FRAMES) & (size < 20))
    start = F.when(tag == TAG_COMMAND, 9).when(tag == TAG_FRAMES, 21).otherwise(5)
    garbled = ~F.is_valid_utf8(F.substr(raw, start).cast("string"))
    error = F.when(short, "short message").when(~tag.isin(*tags), "unknown tag").when(garbled, "bad text")
    checked = tagged.withColumn("error", error)
    good = F.col("error").isNull()
    texts = tag.isin(TAG_REPLY, TAG_CHUNK, TAG_ERROR)
    return checked.withColumns(
        {
            "cmd": F.when(good & (tag == TAG_COMMAND), read_be_int32(raw, 5)),
            "payload": F.when(good & (tag == TAG_COMMAND), text_from(9)).when(good & texts, text_from(5)),
            "client_uuid": F.when(good & (tag == TAG_FRAMES), uuid_text(F.hex(F.substring(raw, 5, 16)))),
            "body": F.when(good & (tag == TAG_FRAMES), text_from(21)).when(good & (tag == TAG_LABELS), text_from(5)),
        }
    )


def frame_bytes(messages: DataFrame) -> DataFrame:
    """Prefix each encoded message with its big-endian length, as on the socket."""
    return messages.withColumn("data", F.concat(be_int32(F.octet_length("wire")), F.col("wire")))

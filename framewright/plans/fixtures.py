"""Views over the test tables that stand in for camera, message, session and detection data.

Every view is a deterministic expression, given once as a DataFrame and once as a SQL CTE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameters, scaled up from the defaults because the events table is sparse.
THROTTLE_PERIOD = 20 * 3600.0
THROTTLE_BURST = 3
BATCH_WINDOW = "1 day"
BATCH_SIZE = 5
BATCH_TIMER = 12 * 3600.0
SESSION_TIMEOUT = 6 * 3600.0
CHECK_DELAY = 3600.0
BREAKER_WINDOW = "1 day"
BREAKER_MAX = 6
RECONNECT = 2 * 3600.0
MASK_THRESHOLD = 15
FRAME_WIDTH, FRAME_HEIGHT = 640, 480


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def client_uuid(user: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex(user)), 12, "0"))


def frames_view(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("device"), "ts", "event_id", "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_view(table(spark, sf_dir, "events"))


def messages_view(events: DataFrame) -> DataFrame:
    kind, eid = F.col("event_type"), F.col("event_id")
    chunk = kind.isin("click", "view")
    codes = F.array(*[F.lit(c) for c in (1, 2, 3, 4, 5, 99)])
    tag = (
        F.when(kind == "purchase", 1)
        .when(kind == "signup", 2)
        .when(chunk, 3)
        .when(eid % 3 == 0, 10)
        .otherwise(4)
    )
    return events.select(
        F.col("user_id").alias("conn"),
        "ts",
        "event_id",
        tag.alias("tag"),
        F.when(kind == "purchase", F.get(codes, (eid % 6).cast("int"))).alias("cmd"),
        F.when((kind == "error") & (eid % 3 == 0), F.lit(None))
        .when(chunk & (eid % 5 == 0), "")
        .otherwise(F.col("props"))
        .alias("payload"),
        F.when((kind == "error") & (eid % 3 == 0), client_uuid(F.col("user_id"))).alias("client_uuid"),
        F.when((kind == "error") & (eid % 3 == 0), F.col("props")).alias("body"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_view(table(spark, sf_dir, "events"))


def chunk_log_view(events: DataFrame) -> DataFrame:
    kind, eid = F.col("event_type"), F.col("event_id")
    return events.where(kind.isin("click", "view", "purchase")).select(
        F.col("user_id").alias("conn"),
        "ts",
        "event_id",
        F.when(kind == "purchase", "O").when(eid % 5 == 0, "T").otherwise("C").alias("role"),
        F.when((kind != "purchase") & (eid % 5 == 0), "").otherwise(F.col("props")).alias("payload"),
    )


def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_log_view(table(spark, sf_dir, "events"))


def session_events_view(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("addr"),
        "ts",
        "event_id",
        F.when(kind == "click", "new")
        .when(kind == "signup", "resolve")
        .when(kind == "error", "reset")
        .when(kind == "tick", "tick")
        .otherwise("message")
        .alias("kind"),
        F.when((kind == "signup") & (F.col("event_id") % 4 != 0), client_uuid(F.col("event_id"))).alias("device_id"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_events_view(table(spark, sf_dir, "events"))


def commands_view(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("conn"), "ts", "event_id", "value"
    )


def replies_view(events: DataFrame) -> DataFrame:
    delay = F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.round(F.col("value") * 60)).cast("decimal(18,6)")
    )
    return commands_view(events).where(F.col("event_id") % 7 != 0).select(
        "conn", (F.col("ts") + delay).alias("ts"), "event_id"
    )


def live_conns_view(events: DataFrame) -> DataFrame:
    return events.where(F.col("user_id") % 10 != 0).select(F.col("user_id").alias("conn")).distinct()


def host_failures_view(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "error").select(
        (F.col("user_id") % 20).alias("host"), "ts", "event_id"
    )


def host_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_failures_view(table(spark, sf_dir, "events"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").where(kind.isin("click", "view", "error")).select(
        F.col("user_id").alias("key"),
        "ts",
        "event_id",
        F.when(kind == "error", "remove").otherwise("add").alias("op"),
    )


def _doubles() -> Column:
    return F.col("embedding").cast("array<double>")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight detections per image from its 64 numbers."""
    e = _doubles()
    places = F.sequence(F.lit(0), F.lit(7))

    def at(i: Column, offset: int) -> Column:
        return F.abs(F.get(e, i * 8 + offset))

    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform(places, lambda i: F.array(at(i, 0), at(i, 1), at(i, 2), at(i, 3))).alias("boxes"),
        F.transform(places, lambda i: F.least(F.lit(1.0), at(i, 4) * 5)).alias("scores"),
        F.transform(places, lambda i: F.floor(at(i, 5) * 100).cast("double")).alias("classes"),
    )


def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("display_name")
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 pixels of 0..255 per image."""
    pixel = F.transform(_doubles(), lambda x: (F.floor(F.abs(x) * 1000) % 256).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", pixel.alias("pixels"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform(_doubles(), lambda x: F.when(x > 0.1, 1).otherwise(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", mask.alias("mask"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.slice(_doubles(), 1, 10).alias("logits")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


def video_view(events: DataFrame) -> DataFrame:
    """One 16-pixel frame per event."""
    pixel = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda j: ((F.floor(F.col("value") * 10) + j * 7) % 256).cast("int"),
    )
    return events.select(F.col("user_id").alias("device"), "ts", "event_id", pixel.alias("pixels"))


def video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video_view(table(spark, sf_dir, "events"))


UUID_SQL = "'00000000-0000-4000-8000-' || lpad(lower(to_hex({0})), 12, '0')"

CTES: dict[str, str] = {
    "frames": "SELECT user_id AS device, ts, event_id, value FROM events",
    "msgs": f"""
        SELECT user_id AS conn, ts, event_id,
          CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'signup' THEN 2
               WHEN event_type IN ('click', 'view') THEN 3 WHEN event_id % 3 = 0 THEN 10 ELSE 4 END AS tag,
          CASE WHEN event_type = 'purchase' THEN
            CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 99 END
          END AS cmd,
          CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL
               WHEN event_type IN ('click', 'view') AND event_id % 5 = 0 THEN '' ELSE props END AS payload,
          CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN {UUID_SQL.format('user_id')} END AS client_uuid,
          CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN props END AS body
        FROM events""",
    "chunks": """
        SELECT user_id AS conn, ts, event_id,
          CASE WHEN event_type = 'purchase' THEN 'O' WHEN event_id % 5 = 0 THEN 'T' ELSE 'C' END AS role,
          CASE WHEN event_type <> 'purchase' AND event_id % 5 = 0 THEN '' ELSE props END AS payload
        FROM events WHERE event_type IN ('click', 'view', 'purchase')""",
    "sess": f"""
        SELECT user_id AS addr, ts, event_id,
          CASE event_type WHEN 'click' THEN 'new' WHEN 'signup' THEN 'resolve'
                          WHEN 'error' THEN 'reset' ELSE 'message' END AS kind,
          CASE WHEN event_type = 'signup' AND event_id % 4 <> 0 THEN {UUID_SQL.format('event_id')} END AS device_id
        FROM events""",
    "cmds": "SELECT user_id AS conn, ts, event_id, value FROM events WHERE event_type = 'purchase'",
    "replies": """
        SELECT conn, ts + to_seconds(CAST(round(value * 60) AS BIGINT)) AS ts, event_id
        FROM cmds WHERE event_id % 7 <> 0""",
    "host_ev": "SELECT user_id % 20 AS host, ts, event_id FROM events WHERE event_type = 'error'",
    "subs": """
        SELECT user_id AS key, ts, event_id, CASE event_type WHEN 'error' THEN 'remove' ELSE 'add' END AS op
        FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "emb": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings",
    "dets": """
        SELECT vec_id, i, abs(e[8 * i + 1]) AS b0, abs(e[8 * i + 2]) AS b1, abs(e[8 * i + 3]) AS b2,
          abs(e[8 * i + 4]) AS b3, least(1.0::DOUBLE, abs(e[8 * i + 5]) * 5) AS score,
          CAST(floor(abs(e[8 * i + 6]) * 100) AS INTEGER) AS class_id
        FROM emb, (SELECT CAST(unnest(range(8)) AS INTEGER) AS i) places""",
    "label_map": "SELECT n_nationkey AS id, n_name AS display_name FROM nation",
    "imgs": """
        SELECT vec_id, label, list_transform(e, lambda x: CAST(floor(abs(x) * 1000) AS INTEGER) % 256) AS px
        FROM emb""",
    "masks": "SELECT vec_id, label, list_transform(e, lambda x: CASE WHEN x > 0.1 THEN 1 ELSE 0 END) AS mask FROM emb",
    "logits": "SELECT vec_id, label, e[1:10] AS z FROM emb",
    "preds": "SELECT vec_id, label, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred FROM logits",
    "samples": "SELECT vec_id AS id, label FROM embeddings",
    "video": """
        SELECT user_id AS device, ts, event_id,
          list_transform(range(16), lambda j: CAST((CAST(floor(value * 10) AS BIGINT) + j * 7) % 256 AS INTEGER)) AS px
        FROM events""",
}

_NEEDS = {
    "replies": ["cmds"],
    "dets": ["emb"],
    "imgs": ["emb"],
    "masks": ["emb"],
    "logits": ["emb"],
    "preds": ["emb", "logits"],
}


def with_views(body: str, *names: str) -> str:
    """A SQL text with the named views in front; ``body`` starts at SELECT or at further CTEs."""
    ordered: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in ordered)
    body = body.strip()
    return f"WITH {ctes}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"

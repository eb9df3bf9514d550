"""Queries that run models, handlers and pixel work in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from framewright.functions.arrays import one_hot
from framewright.operators import background as bg
from framewright.operators import messages as ms
from framewright.operators import dataset as ds
from framewright.operators import handlers as ha
from framewright.operators import minibatch as mb
from framewright.operators import scoring as so
from framewright.operators import training as tr
from framewright.operators.images import resize_bilinear
from framewright.plans import fixtures as fx
from framewright.plans.fixtures import with_views
from framewright.plans.registry import query
from framewright.plans.source_queries import image_bytes
from framewright.plans.stream_queries import events_stream
from framewright.sources.frames import frame_stream_scan
from framewright.sources.sinks import notification_messages
from framewright.streaming.background import stream_background_subtraction
from framewright.streaming.runner import replay_to_table

FRAME_PIXELS, TILE_PIXELS = 16, 8
MOTION_PIXELS = 4


def dense_layers():
    """Two dense layers with fixed weights: 64 -> 8 -> 10."""
    i, j, k = np.arange(64)[:, None], np.arange(8)[None, :], np.arange(10)[None, :]
    first = ((i * 7 + j * 3) % 11 - 5) / 10.0
    second = ((j.T * 5 + k * 2) % 7 - 3) / 4.0
    return [so.Dense(first, np.arange(8) / 10.0), so.LeakyRelu(0.2), so.Dense(second, np.arange(10) / 20.0)]


def conv_layers():
    """A small convolution stack over 8 x 8 gray images: conv, pool, flatten, dense."""
    r, c, o = np.arange(3)[:, None, None], np.arange(3)[None, :, None], np.arange(4)[None, None, :]
    kernel = (((r * 3 + c * 5 + o * 7) % 9 - 4) / 9.0)[:, :, None, :]
    i, j = np.arange(36)[:, None], np.arange(10)[None, :]
    head = ((i * 3 + j * 5) % 13 - 6) / 13.0
    return [so.Conv2d(kernel, np.zeros(4)), so.LeakyRelu(0.1), so.MaxPool(2), so.Flatten(), so.Dense(head, np.zeros(10))]


DENSE_SQL = with_views(
    """WITH first AS (
      SELECT vec_id, label, list_transform(range(8), lambda j: list_sum(list_transform(range(64),
        lambda i: e[CAST(i + 1 AS BIGINT)] * (((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE))) + j / 10.0::DOUBLE) AS h
      FROM emb),
    active AS (SELECT vec_id, label, list_transform(h, lambda x: CASE WHEN x > 0 THEN x ELSE 0.2::DOUBLE * x END) AS h FROM first),
    second AS (
      SELECT vec_id, label, list_transform(range(10), lambda k: list_sum(list_transform(range(8),
        lambda j: h[CAST(j + 1 AS BIGINT)] * (((j * 5 + k * 2) % 7 - 3) / 4.0::DOUBLE))) + k / 20.0::DOUBLE) AS z
      FROM active)
    SELECT vec_id, label, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred,
      round(1.0::DOUBLE / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS probability FROM second""",
    "emb",
)


def _scored(rows):
    model = so.layer_stack(dense_layers, [64])
    scored = so.batch_inference(rows, model)
    return scored.select("vec_id", "label", "pred", F.round("probability", 6).alias("probability"))


def _features(embeddings):
    return embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


@query("batch_inference", DENSE_SQL)
def batch_inference(spark, sf_dir):
    return _scored(_features(fx.table(spark, sf_dir, "embeddings")))


@query("score_stream", DENSE_SQL)
def score_stream(spark, sf_dir):
    arriving = frame_stream_scan(
        spark, f"{sf_dir}/embeddings.parquet*", "vec_id bigint, embedding array<float>, label int", ("embedding",)
    )
    return replay_to_table(_scored(_features(arriving))).drop("batch_id")


CONV_SQL = with_views(
    """WITH filtered AS (
      SELECT vec_id, label, r, c, o, list_sum(list_transform(range(9), lambda t:
        px[CAST((r + t // 3) * 8 + c + t % 3 + 1 AS BIGINT)]
        * ((((t // 3) * 3 + (t % 3) * 5 + o * 7) % 9 - 4) / 9.0::DOUBLE))) AS v
      FROM imgs, (SELECT unnest(range(6)) AS r), (SELECT unnest(range(6)) AS c), (SELECT unnest(range(4)) AS o)),
    pooled AS (
      SELECT vec_id, label, (r // 2 * 3 + c // 2) * 4 + o AS i,
        max(CASE WHEN v > 0 THEN v ELSE 0.1::DOUBLE * v END) AS v
      FROM filtered GROUP BY vec_id, label, r // 2, c // 2, o),
    scored AS (
      SELECT vec_id, label, k, sum(v * (((i * 3 + k * 5) % 13 - 6) / 13.0::DOUBLE)) AS z
      FROM pooled, (SELECT unnest(range(10)) AS k) GROUP BY vec_id, label, k),
    listed AS (SELECT vec_id, label, list(z ORDER BY k) AS z FROM scored GROUP BY vec_id, label)
    SELECT vec_id, label, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred,
      round(1.0::DOUBLE / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS probability FROM listed""",
    "emb",
    "imgs",
)


@query("batch_inference_conv", CONV_SQL)
def batch_inference_conv(spark, sf_dir):
    images = fx.images(spark, sf_dir).select("vec_id", "label", F.col("pixels").cast("array<double>").alias("features"))
    model = so.layer_stack(conv_layers, [8, 8, 1])
    return so.batch_inference(images, model).select("vec_id", "label", "pred", F.round("probability", 6).alias("probability"))


def corner_detector():
    """Eight boxes per 8 x 8 image, one per pixel row, from its values."""

    def detect(images: np.ndarray):
        rows = images.reshape(len(images), 8, 8) / 256.0
        return rows[:, :, :4], np.minimum(1.0, rows[:, :, 4] * 2), np.floor(rows[:, :, 5] * 30)

    return detect


@query(
    "detect_objects",
    with_views(
        """WITH found AS (
          SELECT vec_id, i, px[8 * i + 1] / 256.0::DOUBLE AS b0, px[8 * i + 2] / 256.0::DOUBLE AS b1,
            px[8 * i + 3] / 256.0::DOUBLE AS b2, px[8 * i + 4] / 256.0::DOUBLE AS b3,
            least(1.0::DOUBLE, px[8 * i + 5] / 256.0::DOUBLE * 2) AS score,
            CAST(floor(px[8 * i + 6] / 256.0::DOUBLE * 30) AS INTEGER) AS class_id
          FROM imgs, (SELECT CAST(unnest(range(8)) AS INTEGER) AS i) places)
        SELECT vec_id, i, coalesce(display_name, 'unknown') AS label, CAST(trunc(b0 * 480) AS INTEGER) AS ymin,
          CAST(trunc(b1 * 640) AS INTEGER) AS xmin, CAST(trunc(b2 * 480) AS INTEGER) AS ymax,
          CAST(trunc(b3 * 640) AS INTEGER) AS xmax
        FROM found LEFT JOIN label_map ON class_id = id WHERE score > 0.5""",
        "emb",
        "imgs",
        "label_map",
    ),
)
def detect_objects(spark, sf_dir):
    images = fx.images(spark, sf_dir).select("vec_id", F.col("pixels").cast("array<double>").alias("pixels"))
    model = so.detector(corner_detector, [64])
    drawn = so.detect_objects(images, model, fx.label_map(spark, sf_dir), fx.FRAME_WIDTH, fx.FRAME_HEIGHT)
    return drawn.select("vec_id", "i", "label", "ymin", "xmin", "ymax", "xmax")


@query("mlp_train_predict")
def mlp_train_predict(spark, sf_dir):
    split = ds.ratio_split(fx.samples(spark, sf_dir), 0.67, 42).select(F.col("id").alias("vec_id"), "dataset")
    rows = _features(fx.table(spark, sf_dir, "embeddings")).join(split, "vec_id")
    return tr.mlp_train_predict(rows, [64, 32, 10], max_iter=15)


SGD_STEPS, SGD_RATE = 4, 0.25


def sgd_layers():
    """Fixed weights that any engine can write down: 64 -> 8 -> 10."""
    i, j, k = np.arange(64)[:, None], np.arange(8)[None, :], np.arange(10)[None, :]
    first, second = ((i * 7 + j * 3) % 11 - 5) / 32.0, ((j.T * 5 + k * 2) % 7 - 3) / 8.0
    return [(first, np.full(8, 0.125)), (second, np.full(10, 0.125))]


def sgd_steps_sql(trained: str = "true") -> str:
    """Each step's forward pass, loss, gradients and new weights over the rows ``trained`` holds for, as tables."""
    out = [
        f"""WITH rows AS MATERIALIZED (
          SELECT vec_id AS id, CASE WHEN {trained} THEN vec_id % {SGD_STEPS} ELSE -1 END AS batch, label AS y, embedding FROM embeddings),
        x AS MATERIALIZED (SELECT id, batch, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM rows),
        a0 AS MATERIALIZED (SELECT i, j, ((i * 7 + j * 3) % 11 - 5) / 32.0::DOUBLE AS w FROM range(64) t(i), range(8) u(j)),
        b0 AS MATERIALIZED (SELECT j, 0.125::DOUBLE AS w FROM range(8) t(j)),
        c0 AS MATERIALIZED (SELECT j, k, ((j * 5 + k * 2) % 7 - 3) / 8.0::DOUBLE AS w FROM range(8) t(j), range(10) u(k)),
        d0 AS MATERIALIZED (SELECT k, 0.125::DOUBLE AS w FROM range(10) t(k))"""
    ]
    for t in range(SGD_STEPS):
        n = f"(SELECT count(*) FROM rows WHERE batch = {t})"
        out.append(f"""
        h{t} AS MATERIALIZED (
          SELECT id, j, greatest(sum(v * a.w) + any_value(b.w), 0) AS v FROM x JOIN a{t} a USING (i) JOIN b{t} b USING (j)
          WHERE batch = {t} GROUP BY id, j),
        z{t} AS (SELECT id, k, sum(v * c.w) + any_value(d.w) AS v FROM h{t} JOIN c{t} c USING (j) JOIN d{t} d USING (k) GROUP BY id, k),
        m{t} AS (SELECT id, max(v) AS m FROM z{t} GROUP BY id),
        s{t} AS (SELECT id, any_value(m) + ln(sum(exp(v - m))) AS s FROM z{t} JOIN m{t} USING (id) GROUP BY id),
        p{t} AS MATERIALIZED (
          SELECT id, k, v - s AS log, exp(v - s) - CASE WHEN k = y THEN 1 ELSE 0 END AS d, k = y AS own
          FROM z{t} JOIN s{t} USING (id) JOIN rows USING (id)),
        e{t} AS MATERIALIZED (
          SELECT id, j, sum(d * c.w) * CASE WHEN any_value(h.v) > 0 THEN 1 ELSE 0 END AS d
          FROM p{t} JOIN c{t} c USING (k) JOIN h{t} h USING (id, j) GROUP BY id, j),
        a{t + 1} AS MATERIALIZED (
          SELECT i, j, any_value(w) - {SGD_RATE} * sum(v * d) / {n} AS w FROM x JOIN e{t} USING (id) JOIN a{t} USING (i, j) GROUP BY i, j),
        b{t + 1} AS MATERIALIZED (SELECT j, any_value(w) - {SGD_RATE} * sum(d) / {n} AS w FROM e{t} JOIN b{t} USING (j) GROUP BY j),
        c{t + 1} AS MATERIALIZED (
          SELECT j, k, any_value(w) - {SGD_RATE} * sum(v * d) / {n} AS w FROM h{t} JOIN p{t} USING (id) JOIN c{t} USING (j, k) GROUP BY j, k),
        d{t + 1} AS MATERIALIZED (SELECT k, any_value(w) - {SGD_RATE} * sum(d) / {n} AS w FROM p{t} JOIN d{t} USING (k) GROUP BY k)""")
    return ",".join(out)


def sgd_sql() -> str:
    losses = " UNION ALL ".join(f"SELECT {t} AS step, -avg(log) AS loss FROM p{t} WHERE own" for t in range(SGD_STEPS))
    return sgd_steps_sql() + f" SELECT CAST(step AS INTEGER) AS step, round(loss, 9) AS loss FROM ({losses})"


@query("mlp_minibatch_loss", sgd_sql())
def mlp_minibatch_loss(spark, sf_dir):
    """The loss of each step of an epoch of training on the embeddings' labels."""
    rows = _features(fx.table(spark, sf_dir, "embeddings")).withColumn("batch", F.col("vec_id") % SGD_STEPS)
    _, losses = mb.train_minibatches(rows, sgd_layers(), SGD_STEPS, SGD_RATE)
    return spark.createDataFrame(list(enumerate(losses)), "step int, loss double").withColumn("loss", F.round("loss", 9))


def sgd_predict_sql() -> str:
    """The trained layers over all rows, the first of the largest outputs, and how often it is the label."""
    t = SGD_STEPS
    return (
        sgd_steps_sql("vec_id % 3 <> 0")
        + f""",
        hidden AS MATERIALIZED (
          SELECT id, j, greatest(sum(v * a.w) + any_value(b.w), 0) AS v FROM x JOIN a{t} a USING (i) JOIN b{t} b USING (j) GROUP BY id, j),
        outputs AS MATERIALIZED (
          SELECT id, k, sum(v * c.w) + any_value(d.w) AS v FROM hidden JOIN c{t} c USING (j) JOIN d{t} d USING (k) GROUP BY id, k),
        judged AS (
          SELECT CASE WHEN id % 3 <> 0 THEN 'train' ELSE 'test' END AS dataset, CASE WHEN pred = y THEN 1 ELSE 0 END AS hit
          FROM (SELECT id, arg_max(k, v) AS pred FROM outputs GROUP BY id) JOIN rows USING (id))
        SELECT dataset, CAST(count(*) AS BIGINT) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 9) AS accuracy
        FROM judged GROUP BY dataset"""
    )


@query("mlp_minibatch_predict", sgd_predict_sql())
def mlp_minibatch_predict(spark, sf_dir):
    """Two thirds of the embeddings train for an epoch; how often the layers then name the label, in both parts."""
    rows = _features(fx.table(spark, sf_dir, "embeddings")).withColumn("batch", F.col("vec_id") % SGD_STEPS)
    layers, _ = mb.train_minibatches(rows.where("vec_id % 3 != 0"), sgd_layers(), SGD_STEPS, SGD_RATE)
    hit = (F.col("pred") == F.col("label")).cast("int")
    return (
        mb.predict(rows, layers)
        .groupBy(F.when(F.col("vec_id") % 3 != 0, "train").otherwise("test").alias("dataset"))
        .agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.round(F.avg(hit), 9).alias("accuracy"))
    )


@query("mlp_train_predict_events")
def mlp_train_predict_events(spark, sf_dir):
    """The small classifier: four numeric columns of every event, one hidden layer of ten."""
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    numbers = [F.hour("ts"), F.dayofweek("ts"), F.log1p("value"), F.col("user_id") % 10]
    rows = fx.table(spark, sf_dir, "events").select(
        F.array(*[n.cast("double") for n in numbers]).alias("features"),
        (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("label"),
        F.when(F.pmod(F.xxhash64("event_id"), F.lit(100)) < 67, "train").otherwise("test").alias("dataset"),
    )
    return tr.mlp_train_predict(rows, [4, 10, 5], max_iter=15)


@query(
    "mlp_train_predict_separable",
    """SELECT CASE WHEN event_id % 3 <> 0 THEN 'train' ELSE 'test' END AS dataset, CAST(count(*) AS BIGINT) AS n,
      CAST(1 AS DOUBLE) AS accuracy FROM events GROUP BY 1""",
)
def mlp_train_predict_separable(spark, sf_dir):
    """A target that its features give away, so a trained network must get every row right."""
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    label = (F.array_position(kinds, F.col("event_type")) - 1).cast("int")
    rows = fx.table(spark, sf_dir, "events").select(
        one_hot(label, 5).cast("array<double>").alias("features"),
        label.alias("label"),
        F.when(F.col("event_id") % 3 != 0, "train").otherwise("test").alias("dataset"),
    )
    return tr.mlp_train_predict(rows, [5, 8, 5], max_iter=100)


@query(
    "resize_bilinear",
    with_views(
        """WITH places AS (
          SELECT y, x, CAST(floor(y * 0.5::DOUBLE) AS INTEGER) AS y0, CAST(floor(x * 0.5::DOUBLE) AS INTEGER) AS x0,
            y * 0.5::DOUBLE - floor(y * 0.5::DOUBLE) AS fy, x * 0.5::DOUBLE - floor(x * 0.5::DOUBLE) AS fx
          FROM (SELECT unnest(range(16)) AS y), (SELECT unnest(range(16)) AS x)),
        pixels AS (
          SELECT vec_id, y, x, CAST(trunc(
            (px[y0 * 8 + x0 + 1] * (1 - fx) + px[y0 * 8 + least(x0 + 1, 7) + 1] * fx) * (1 - fy)
            + (px[least(y0 + 1, 7) * 8 + x0 + 1] * (1 - fx) + px[least(y0 + 1, 7) * 8 + least(x0 + 1, 7) + 1] * fx) * fy
          ) AS INTEGER) AS v FROM imgs, places)
        SELECT vec_id, upper(string_agg(printf('%02X', v), '' ORDER BY y, x)) AS pixels FROM pixels GROUP BY vec_id""",
        "emb",
        "imgs",
    ),
)
def resize_bilinear_query(spark, sf_dir):
    images = fx.images(spark, sf_dir).select("vec_id", image_bytes(F.col("pixels")).alias("data"))
    resized = resize_bilinear(16, 16)(F.lit(8), F.lit(8), F.lit(1), F.col("data"))
    return images.select("vec_id", F.hex(resized).alias("pixels"))


def video_bytes(frames):
    return frames.select("device", "ts", "event_id", image_bytes(F.col("pixels")).alias("data"))


def mixture_sql(params: bg.MixtureParams = bg.MixtureParams()) -> str:
    """Every pixel's mixture as a recursive query over its device's frames, in the order of operations of the
    model; gives (device, pixel, n, fg) for the n-th frame of each device."""
    ks = range(params.components)
    alpha, half = params.rate(), "::DOUBLE"

    def each(form: str, sep: str = ", ") -> str:
        return sep.join(form.format(k=k, up=" + ".join(f"w{i}" for i in range(k + 1)), at=k + 1) for k in ks)

    owner = "CASE " + " ".join(f"WHEN a{k} AND d{k} < {params.generation_threshold}{half} * v{k} THEN {k}" for k in ks) + " ELSE -1 END"
    least = "CASE WHEN own >= 0 THEN -1 " + " ".join(
        f"WHEN {' AND '.join(f'g{k} <= g{i}' for i in ks)} THEN {k}" for k in ks
    ) + " END"
    return f"""
      WITH px AS (
        SELECT device, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) - 1 AS n,
          unnest(range({FRAME_PIXELS})) AS pixel, unnest(px)::DOUBLE AS x FROM video),
      st AS (
        SELECT DISTINCT device, pixel, CAST(-1 AS BIGINT) AS n, CAST(0 AS INTEGER) AS fg,
          {each("0" + half + " AS w{k}, 0" + half + " AS m{k}, 0" + half + " AS v{k}")} FROM px
        UNION ALL
        SELECT device, pixel, n, CASE WHEN behind THEN 0 ELSE 1 END,
          {each("-c[{at}].w, c[{at}].m, c[{at}].v")}
        FROM (SELECT *, list_sort([{each("{{'w': -(w{k} / total), 'i': {k}, 'm': m{k}, 'v': v{k}}}")}]) AS c
        FROM (SELECT *, {each("w{k}", " + ")} AS total
        FROM (SELECT device, pixel, n, behind,
          {each(f"CASE WHEN slot = {{k}} THEN {alpha}{half} ELSE g{{k}} END AS w{{k}}")},
          {each("CASE WHEN slot = {k} THEN x ELSE m{k} END AS m{k}")},
          {each(f"CASE WHEN slot = {{k}} THEN {params.initial_variance}{half} ELSE v{{k}} END AS v{{k}}")}
        FROM (SELECT *, {least} AS slot
        FROM (SELECT device, pixel, n, x, behind, own, {each("greatest(u{k}, 0" + half + ") AS g{k}")},
          {each("CASE WHEN own = {k} THEN m{k} + s{k} * o{k} ELSE m{k} END AS m{k}")},
          {each(f"CASE WHEN own = {{k}} THEN least(greatest(v{{k}} + s{{k}} * (d{{k}} - v{{k}}), {params.min_variance}{half}), {params.max_variance}{half}) ELSE v{{k}} END AS v{{k}}")}
        FROM (SELECT *, {each(f"CASE WHEN own = {{k}} THEN least({alpha}{half} / u{{k}}, 1{half}) END AS s{{k}}")}
        FROM (SELECT *, {each(f"w{{k}} * {1 - alpha}{half} - CASE WHEN a{{k}} THEN {alpha * params.complexity}{half} ELSE 0{half} END + CASE WHEN own = {{k}} THEN {alpha}{half} ELSE 0{half} END AS u{{k}}")}
        FROM (SELECT *, {owner} AS own,
          {each(f"(a{{k}} AND h{{k}} < {params.background_ratio}{half} AND d{{k}} < {params.threshold}{half} * v{{k}})", " OR ")} AS behind
        FROM (SELECT *, {each("w{k} > 0 AS a{k}, x - m{k} AS o{k}, (x - m{k}) * (x - m{k}) AS d{k}, ({up}) - w{k} AS h{k}")}
        FROM (SELECT st.* EXCLUDE (n, fg), p.n, p.x FROM st JOIN px p
          ON p.device = st.device AND p.pixel = st.pixel AND p.n = st.n + 1))))))))))),
      seen AS (
        SELECT device, ts, event_id, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) - 1 AS n FROM video)"""


def background_sql(select: str) -> str:
    return with_views(mixture_sql() + select, "video").replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "background_subtraction",
    background_sql(f"""
      SELECT device, CAST(pixel // {TILE_PIXELS} AS INTEGER) AS tile, ts, event_id,
        string_agg('0' || fg, '' ORDER BY pixel) AS mask, CAST(sum(fg) AS INTEGER) AS foreground
      FROM st JOIN seen USING (device, n) GROUP BY ALL"""),
)
def background_subtraction(spark, sf_dir):
    masks = bg.background_subtraction(video_bytes(fx.video(spark, sf_dir)), FRAME_PIXELS, TILE_PIXELS)
    return masks.select("device", "tile", "ts", "event_id", F.hex("mask").alias("mask"), "foreground")


def _motion_notifications(spark, sf_dir):
    """Background model, motion filter and outgoing notifications in one plan."""
    frames = fx.video(spark, sf_dir)
    moving = bg.motion_frames(video_bytes(frames), FRAME_PIXELS, TILE_PIXELS, MOTION_PIXELS)
    return notification_messages(moving, fx.client_uuid(F.col("device")), fx.BATCH_SIZE, fx.BATCH_WINDOW, frames)


@query("motion_alerts")
def motion_alerts(spark, sf_dir):
    """The notifications as they go out."""
    return _motion_notifications(spark, sf_dir).select("conn", "window_start", "batch", F.hex("data").alias("data"))


@query(
    "motion_pipeline",
    background_sql(f""", moving AS (
        SELECT device, ts, event_id FROM st JOIN seen USING (device, n) GROUP BY ALL HAVING sum(fg) > {MOTION_PIXELS}),
      placed AS (
        SELECT *, row_number() OVER (PARTITION BY device, date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS rn FROM moving)
      SELECT device AS conn, date_trunc('day', ts) AS window_start, CAST(rn // {fx.BATCH_SIZE} AS BIGINT) AS batch,
        {fx.UUID_SQL.format('device')} AS client_uuid, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS ids
      FROM placed GROUP BY device, date_trunc('day', ts), rn // {fx.BATCH_SIZE}"""),
)
def motion_pipeline(spark, sf_dir):
    """The notifications of frames with motion, decoded as the server would."""
    sent = _motion_notifications(spark, sf_dir)
    decoded = ms.decode_messages(sent.withColumn("wire", F.substr(F.col("data"), F.lit(5))))
    ids = F.from_json("body", "array<struct<event_id:bigint>>")["event_id"].cast("array<string>")
    return decoded.select("conn", "window_start", "batch", "client_uuid", F.array_join(ids, ",").alias("ids"))


@query(
    "stream_background_subtraction",
    background_sql(" SELECT device, ts, event_id, CAST(sum(fg) AS BIGINT) AS fg_pixels FROM st JOIN seen USING (device, n) GROUP BY ALL"),
)
def stream_background_subtraction_query(spark, sf_dir):
    return stream_background_subtraction(
        video_bytes(fx.video_view(events_stream(spark, sf_dir))), FRAME_PIXELS, TILE_PIXELS
    )


@query(
    "handler_signal",
    with_views("SELECT event_id, conn, 'That is OK: ' || coalesce(payload, '') AS reply FROM msgs", "msgs"),
)
def handler_signal(spark, sf_dir):
    def answer(payload: pd.Series) -> pd.Series:
        return "That is OK: " + payload.fillna("")

    rows = ha.handler_signal(fx.messages(spark, sf_dir), answer, ["payload"], "reply", "string")
    return rows.select("event_id", "conn", "reply")


@query(
    "handler_consume_stream",
    with_views(
        """SELECT conn, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(payload)) AS BIGINT) AS total
        FROM msgs WHERE tag = 3 GROUP BY conn""",
        "msgs",
    ),
)
def handler_consume_stream(spark, sf_dir):
    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return parts.groupby("conn", as_index=False)[["n", "total"]].sum()

    def partial(batch: pd.DataFrame) -> pd.DataFrame:
        return merge(batch.assign(n=1, total=batch["payload"].str.len()))

    chunks = fx.messages(spark, sf_dir).where(F.col("tag") == 3).select("conn", "payload")
    return ha.handler_consume_stream(chunks, ["conn"], partial, merge, "conn bigint, n bigint, total bigint")


@query(
    "handler_produce_stream",
    with_views(
        """SELECT event_id, conn, CAST(pos AS INTEGER) AS pos, 'part ' || pos || ' of ' || (event_id % 4) AS item
        FROM msgs, (SELECT unnest(range(3)) AS pos) WHERE pos < event_id % 4""",
        "msgs",
    ),
)
def handler_produce_stream(spark, sf_dir):
    def parts(event_id: pd.Series) -> pd.Series:
        return event_id.map(lambda e: [f"part {i} of {e % 4}" for i in range(min(e % 4, 3))])

    rows = fx.messages(spark, sf_dir).select("event_id", "conn")
    return ha.handler_produce_stream(rows, parts, ["event_id"], "string")


class Numbered:
    """Some parts of each message of a connection, numbered through."""

    def __init__(self):
        self.seq = 0

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        n = np.minimum(batch.column("event_id").to_numpy() % 4, 3)
        at = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        event, conn = (batch.column(c).take(pa.array(at)) for c in ("event_id", "conn"))
        items = [f"part {i} of {k}" for i, k in zip(pos.tolist(), (event.to_numpy() % 4).tolist(), strict=True)]
        seq = pa.array(np.arange(self.seq, self.seq + len(at)))
        self.seq += len(at)
        yield pa.table({"event_id": event, "conn": conn, "seq": seq, "item": pa.array(items, pa.string())})


@query(
    "handler_produce_table",
    with_views(
        """SELECT event_id, conn, CAST(row_number() OVER (PARTITION BY conn ORDER BY ts, event_id, pos) - 1 AS BIGINT) AS seq,
          'part ' || pos || ' of ' || (event_id % 4) AS item
        FROM msgs, (SELECT unnest(range(3)) AS pos) WHERE pos < event_id % 4""",
        "msgs",
    ),
)
def handler_produce_table(spark, sf_dir):
    """The parts of messages as one sequence per connection."""
    rows = fx.messages(spark, sf_dir).select("event_id", "conn", "ts")
    schema = "event_id bigint, conn bigint, seq bigint, item string"
    return ha.handler_produce_table(rows, ["conn"], ["ts", "event_id"], Numbered, schema)


@query(
    "handler_process_stream",
    with_views(
        """SELECT conn, event_id, CAST(sum(length(coalesce(payload, ''))) OVER (
          PARTITION BY conn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seen FROM msgs""",
        "msgs",
    ),
)
def handler_process_stream(spark, sf_dir):
    def running(key, batches):
        total = 0
        for batch in batches:
            sizes = batch["payload"].fillna("").str.len().cumsum() + total
            total = int(sizes.iloc[-1])
            yield pd.DataFrame({"conn": key[0], "event_id": batch["event_id"], "seen": sizes})

    rows = fx.messages(spark, sf_dir).select("conn", "ts", "event_id", "payload")
    schema = "conn bigint, event_id bigint, seen bigint"
    return ha.handler_process_stream(rows, ["conn"], ["ts", "event_id"], running, schema)

"""Queries over detector output, images and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import arrays as ar
from framewright.functions import scalar as sc
from framewright.operators import detection as de
from framewright.plans import fixtures as fx
from framewright.plans.fixtures import with_views
from framewright.plans.registry import query


@query(
    "detection_filter",
    with_views(
        "SELECT vec_id, i, round(score, 6) AS score, class_id, round(b0, 6) AS ymin FROM dets WHERE score > 0.5",
        "dets",
    ),
)
def detection_filter(spark, sf_dir):
    kept = de.detection_filter(fx.detections(spark, sf_dir))
    return kept.select(
        "vec_id",
        "i",
        F.round("score", 6).alias("score"),
        F.col("class").cast("int").alias("class_id"),
        F.round(F.col("box")[0], 6).alias("ymin"),
    )


@query(
    "label_lookup",
    with_views(
        """SELECT vec_id, i, class_id, coalesce(display_name, 'unknown') AS label
        FROM dets LEFT JOIN label_map ON class_id = id WHERE score > 0.5""",
        "dets",
        "label_map",
    ),
)
def label_lookup(spark, sf_dir):
    kept = de.detection_filter(fx.detections(spark, sf_dir))
    named = de.label_lookup(kept, fx.label_map(spark, sf_dir))
    return named.select("vec_id", "i", "class_id", "label")


_CORNERS = """CAST(trunc(b0 * 480) AS INTEGER) AS ymin, CAST(trunc(b1 * 640) AS INTEGER) AS xmin,
  CAST(trunc(b2 * 480) AS INTEGER) AS ymax, CAST(trunc(b3 * 640) AS INTEGER) AS xmax"""


@query("scale_boxes", with_views(f"SELECT vec_id, i, {_CORNERS} FROM dets WHERE score > 0.5", "dets"))
def scale_boxes(spark, sf_dir):
    kept = de.detection_filter(fx.detections(spark, sf_dir))
    scaled = de.scale_boxes(kept, fx.FRAME_WIDTH, fx.FRAME_HEIGHT)
    return scaled.select("vec_id", "i", "ymin", "xmin", "ymax", "xmax")


ANNOTATIONS_SQL = with_views(
    f"""WITH corners AS (SELECT vec_id, i, score, class_id, {_CORNERS} FROM dets WHERE score > 0.5)
    SELECT vec_id, i, coalesce(display_name, 'unknown') AS label, CAST(floor(score * 100 + 0.5) AS INTEGER) AS percent,
      coalesce(display_name, 'unknown') || ' (' AS caption_head, xmin + 4 AS text_x, ymin + 36 AS text_y,
      ymin, xmin, ymax, xmax
    FROM corners LEFT JOIN label_map ON class_id = id""",
    "dets",
    "label_map",
)


@query("annotations", ANNOTATIONS_SQL)
def annotations(spark, sf_dir):
    drawn = de.annotations(
        fx.detections(spark, sf_dir), fx.label_map(spark, sf_dir), fx.FRAME_WIDTH, fx.FRAME_HEIGHT
    )
    return drawn.select(
        "vec_id",
        "i",
        "label",
        F.floor(F.col("score") * 100 + 0.5).cast("int").alias("percent"),
        F.regexp_extract("caption", r"^(.* \()\d\.\d\d\)$", 1).alias("caption_head"),
        "text_x",
        "text_y",
        "ymin",
        "xmin",
        "ymax",
        "xmax",
    )


def _text(column):
    return F.array_join(column.cast("array<string>"), ",")


_GRID = "list_transform(range(8), lambda r: px[CAST(r * 8 + 1 AS BIGINT):CAST(r * 8 + 8 AS BIGINT)])"


@query(
    "flip_horizontal",
    with_views(
        f"""SELECT vec_id, array_to_string(flatten(list_transform({_GRID}, lambda w: list_reverse(w))), ',') AS pixels
        FROM imgs""",
        "emb",
        "imgs",
    ),
)
def flip_horizontal(spark, sf_dir):
    grid = ar.reshape(F.col("pixels"), 8, 8)
    return fx.images(spark, sf_dir).select("vec_id", _text(F.flatten(ar.flip_horizontal(grid))).alias("pixels"))


@query(
    "bgr_to_rgb",
    with_views(
        """SELECT vec_id, array_to_string(flatten(list_transform(range(21), lambda p:
          [px[CAST(p * 3 + 3 AS BIGINT)], px[CAST(p * 3 + 2 AS BIGINT)], px[CAST(p * 3 + 1 AS BIGINT)]])), ',') AS pixels
        FROM imgs""",
        "emb",
        "imgs",
    ),
)
def bgr_to_rgb(spark, sf_dir):
    pixels = ar.reshape(F.col("pixels"), 21, 3)
    return fx.images(spark, sf_dir).select("vec_id", _text(F.flatten(ar.bgr_to_rgb(pixels))).alias("pixels"))


@query(
    "pixel_scale",
    with_views(
        """WITH bounds AS (SELECT min(list_min(px)) AS lo, max(list_max(px)) AS hi FROM imgs)
        SELECT vec_id, round(list_sum(list_transform(px, lambda x: x / 255.0::DOUBLE)), 6) AS sum_scaled,
          round(px[1] / 255.0::DOUBLE, 6) AS first_scaled,
          round((px[64] - (SELECT lo FROM bounds)) / CAST((SELECT hi - lo FROM bounds) AS DOUBLE), 6) AS last_ranged
        FROM imgs""",
        "emb",
        "imgs",
    ),
)
def pixel_scale(spark, sf_dir):
    images = fx.images(spark, sf_dir)
    low = images.agg(F.min(F.array_min("pixels"))).scalar().cast("double")
    high = images.agg(F.max(F.array_max("pixels"))).scalar().cast("double")
    scaled = images.withColumn("scaled", ar.scale_pixels(F.col("pixels")))
    ranged = scaled.withColumn("lo", low).withColumn("hi", high)
    return ranged.select(
        "vec_id",
        F.round(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_scaled"),
        F.round(F.col("scaled")[0], 6).alias("first_scaled"),
        F.round(ar.scale_pixels(F.col("pixels"), F.col("lo"), F.col("hi"))[63], 6).alias("last_ranged"),
    )


@query(
    "flatten_cast",
    with_views(
        """SELECT vec_id, CAST(len(px) AS INTEGER) AS width, CAST(list_sum(px) AS DOUBLE) AS total,
          CAST(px[10] AS DOUBLE) AS tenth FROM imgs""",
        "emb",
        "imgs",
    ),
)
def flatten_cast(spark, sf_dir):
    vector = ar.flatten_cast(ar.reshape(F.col("pixels"), 8, 8))
    return fx.images(spark, sf_dir).withColumn("v", vector).select(
        "vec_id",
        F.size("v").alias("width"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"),
        F.col("v")[9].cast("double").alias("tenth"),
    )


@query(
    "one_hot",
    """SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '')
    AS bits FROM embeddings""",
)
def one_hot(spark, sf_dir):
    bits = ar.one_hot(F.col("label"), 10).cast("array<string>")
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(bits, "").alias("bits"))


@query(
    "top_class",
    with_views("SELECT vec_id, label, pred FROM preds", "preds"),
)
def top_class(spark, sf_dir):
    return fx.logits(spark, sf_dir).select("vec_id", "label", ar.argmax(F.col("logits")).alias("pred"))


@query(
    "softmax",
    with_views(
        """WITH shifted AS (
          SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS w FROM logits)
        SELECT vec_id, CAST(unnest(range(10)) AS INTEGER) AS i,
          round(unnest(list_transform(w, lambda x: x / list_sum(w))), 9) AS p FROM shifted""",
        "logits",
    ),
)
def softmax(spark, sf_dir):
    scored = fx.logits(spark, sf_dir).select("vec_id", F.posexplode(ar.softmax(F.col("logits"))).alias("i", "p"))
    return scored.select("vec_id", "i", F.round("p", 9).alias("p"))


@query(
    "scalar_suite",
    """SELECT event_id, CAST(length(props) AS INTEGER) AS n_units, props = '' AS is_empty,
      trim(split_part(event_type || ' , ' || props, ',', 1)) AS head,
      TRY_CAST(CASE WHEN event_id % 10 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number,
      replace('/10.0.0.' || user_id || ':80/', '/', '_') AS safe_name,
      regexp_matches(CASE WHEN event_id % 2 = 0 THEN 'graph.pb' ELSE 'graph.pbtxt' END, '.*\\.pb$') AS is_graph,
      event_type || ' (' AS caption_head,
      CAST(event_id + user_id AS VARCHAR) AS sum_text,
      CASE WHEN event_id % 3 <> 0 THEN '00000000-0000-4000-8000-' || lpad(lower(to_hex(event_id)), 12, '0') END AS parsed,
      lower(printf('%08x', user_id) || '-0000-0000-0000-' || printf('%012x', event_id)) AS long_uuid,
      ts + INTERVAL 2 SECOND AS later, CAST(trunc(value * 640) AS INTEGER) AS scaled,
      CAST(event_id // 128 AS BIGINT) AS step, event_id % 2 = user_id % 2 AS same_parity,
      CASE user_id % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'unknown' END AS looked_up,
      printf('%08X', CAST(event_id AS INTEGER)) AS be_hex, CAST(event_id AS INTEGER) AS be_read,
      event_id || ',' || user_id AS pair, CAST(user_id AS INTEGER) AS squeezed
    FROM events""",
)
def scalar_suite(spark, sf_dir):
    eid, user = F.col("event_id"), F.col("user_id")
    address = F.concat(F.lit("/10.0.0."), user.cast("string"), F.lit(":80/"))
    model = F.when(eid % 2 == 0, "graph.pb").otherwise("graph.pbtxt")
    maybe_uuid = F.when(eid % 3 != 0, fx.client_uuid(eid)).otherwise("not-a-uuid")
    names = F.map_from_entries(
        F.array(F.struct(F.lit(0), F.lit("zero")), F.struct(F.lit(1), F.lit("one")))
    )
    maybe_number = F.when(eid % 10 == 0, "x").otherwise(eid.cast("string"))
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        sc.utf16_length(F.col("props")).alias("n_units"),
        (F.col("props") == "").alias("is_empty"),
        F.trim(F.split(F.concat("event_type", F.lit(" , "), "props"), ",")[0]).alias("head"),
        maybe_number.try_cast("double").alias("number"),
        sc.file_safe(address).alias("safe_name"),
        model.rlike(r".*\.pb$").alias("is_graph"),
        F.regexp_extract(sc.caption(F.col("event_type"), F.col("value")), r"^(\w+ \()", 1).alias("caption_head"),
        (eid + user).cast("string").alias("sum_text"),
        sc.parse_uuid(maybe_uuid).alias("parsed"),
        sc.uuid_from_longs(F.shiftleft(user, 32), eid).alias("long_uuid"),
        (F.col("ts") + sc.seconds_interval(2)).alias("later"),
        sc.truncate_product(F.col("value"), 640).alias("scaled"),
        F.floor(eid / 128).alias("step"),
        ((eid % 2) == (user % 2)).alias("same_parity"),
        F.coalesce(F.try_element_at(names, (user % 4).cast("int")), F.lit("unknown")).alias("looked_up"),
        F.hex(sc.be_int32(eid)).alias("be_hex"),
        sc.read_be_int32(sc.be_int32(eid), 1).alias("be_read"),
        _text(F.flatten(F.array(F.array(eid), F.slice(F.array(eid, user), 2, 1)))).alias("pair"),
        F.array(user.cast("int"))[0].alias("squeezed"),
    )

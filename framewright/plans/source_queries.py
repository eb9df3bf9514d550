"""Queries that land a table in a source format, or a stream in sinks, and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import dataset as ds
from framewright.operators import messages as ms
from framewright.plans import fixtures as fx
from framewright.plans.dataset_queries import PERCENT_SPLIT_SQL, SEED
from framewright.plans.fixtures import with_views
from framewright.plans.registry import query
from framewright.plans.stream_queries import DELAY, EVENTS_SCHEMA, WINDOW_DELAY, events_stream
from framewright.session import work_path
from framewright.sources import image_folders, sinks, tables, tensor_records
from framewright.streaming.runner import write_batch


def image_bytes(pixels):
    """An array of 0..255 as bytes."""
    return F.unhex(F.array_join(F.transform(pixels, lambda p: F.lpad(F.hex(p.cast("bigint")), 2, "0")), ""))


@query(
    "labelled_image_scan",
    with_views(
        """SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(sum(list_sum(px)) AS BIGINT) AS pixel_sum,
          CAST(min(8) AS INTEGER) AS height, CAST(max(8) AS INTEGER) AS width
        FROM (SELECT CAST(label AS VARCHAR) AS label, px FROM imgs) GROUP BY label""",
        "emb",
        "imgs",
    ),
)
def labelled_image_scan(spark, sf_dir):
    """Write one image file per row into class folders, scan and decode them."""
    root = work_path(spark, "images")
    named = fx.images(spark, sf_dir).select(
        F.col("label").cast("string").alias("label"),
        F.format_string("%d.jpg", "vec_id").alias("name"),
        image_bytes(F.col("pixels")).alias("data"),
    )
    image_folders.write_image_folders(named, root, 8, 8).write.format("noop").mode("overwrite").save()
    files = image_folders.labelled_image_scan(spark, root).select("path", F.col("label").alias("folder"))
    decoded = image_folders.decoded_image_scan(spark, root)
    # both scans name the same files; paths differ in their scheme prefix only
    tail = F.substring_index("path", "/", -2)
    pixels = F.transform(
        F.sequence(F.lit(1), F.octet_length("data")),
        lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10).cast("bigint"),
    )
    sums = decoded.select(
        tail.alias("file"), "height", "width", F.aggregate(pixels, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("s")
    )
    return (
        files.select("folder", tail.alias("file"))
        .join(sums, "file")
        .groupBy(F.col("folder").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("s").alias("pixel_sum"),
            F.min("height").alias("height"),
            F.max("width").alias("width"),
        )
    )


@query(
    "csv_feature_scan",
    """SELECT CAST(user_id AS DOUBLE) AS f0, value AS f1, CAST(event_id % 100 AS DOUBLE) AS f2,
      CAST(length(props) AS DOUBLE) AS f3,
      CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END
        AS INTEGER) AS label FROM events""",
)
def csv_feature_scan(spark, sf_dir):
    path = work_path(spark, "csv")
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    rows = fx.table(spark, sf_dir, "events").select(
        "user_id",
        "value",
        (F.col("event_id") % 100).alias("k"),
        F.length("props").alias("size"),
        (F.array_position(kinds, F.col("event_type")) - 1).alias("label"),
    )
    tables.write_csv_features(rows, path, ["user_id", "value", "k", "size"], "label")
    scanned = tables.csv_feature_scan(spark, path)
    return scanned.select(*[F.col("features")[i].alias(f"f{i}") for i in range(4)], "label")


@query(
    "tensor_record_scan",
    with_views(
        """SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width,
          count(DISTINCT array_to_string(px, ',')) AS n_distinct, min(array_to_string(px, ',')) AS smallest
        FROM imgs GROUP BY label""",
        "emb",
        "imgs",
    ),
)
def tensor_record_scan(spark, sf_dir):
    path = work_path(spark, "records")
    tensor_records.register(spark)
    images = fx.images(spark, sf_dir).select(image_bytes(F.col("pixels")).alias("data"), "label")
    images.write.format("tensor_records").mode("append").option("shape", "8x8").save(path)
    records = spark.read.format("tensor_records").load(path)
    digits = F.transform(
        F.sequence(F.lit(1), F.octet_length("data")),
        lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10),
    )
    text = records.select("label", "shape", F.array_join(digits, ",").alias("text"))
    return text.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.col("shape")[0]).alias("height"),
        F.max(F.col("shape")[1]).alias("width"),
        F.countDistinct("text").alias("n_distinct"),
        F.min("text").alias("smallest"),
    )


@query(
    "label_map_scan",
    """WITH items AS (
      SELECT p_partkey AS pos, CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_partkey % 1500 AS INTEGER) END AS id,
        CASE WHEN p_partkey % 19 <> 0 THEN p_name || ' ' || p_partkey END AS display_name FROM part)
    SELECT id, arg_max(display_name, pos) AS display_name FROM items
    WHERE id IS NOT NULL AND display_name IS NOT NULL GROUP BY id""",
)
def label_map_scan(spark, sf_dir):
    """A label map rendered from parts, with repeated ids and incomplete items."""
    path = work_path(spark, "labels")
    key = F.col("p_partkey")
    items = fx.table(spark, sf_dir, "part").select(
        key.alias("pos"),
        F.when(key % 17 != 0, (key % 1500).cast("int")).alias("id"),
        F.when(key % 19 != 0, F.concat_ws(" ", "p_name", key)).alias("display_name"),
    )
    tables.write_label_map(items, path)
    return tables.label_map_scan(spark, path)


@query(
    "split_dataset_write",
    with_views(
        PERCENT_SPLIT_SQL
        + """SELECT dataset, label, CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS id_sum
        FROM split WHERE dataset IS NOT NULL GROUP BY dataset, label""",
        "samples",
    ),
)
def split_dataset_write(spark, sf_dir):
    path = work_path(spark, "split")
    tables.split_dataset_write(ds.percent_split(fx.samples(spark, sf_dir), (70, 20, 5), SEED), path)
    back = spark.read.parquet(path)
    return back.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query(
    "fan_out_sinks",
    with_views(
        """SELECT CAST(sink AS INTEGER) AS sink, device, event_id, ts
        FROM frames, (SELECT unnest(range(3)) AS sink)""",
        "frames",
    ),
)
def fan_out_sinks(spark, sf_dir):
    frames = fx.frames_view(events_stream(spark, sf_dir))
    copies = sinks.fan_out_sinks(frames, work_path(spark, "fan"), 3)
    tagged = [copy.select(F.lit(i).alias("sink"), "device", "event_id", "ts") for i, copy in enumerate(copies)]
    return ms.merge_streams(*tagged)


@query(
    "fan_out_own_pace",
    """WITH placed AS (
      SELECT user_id AS device, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS slice FROM events),
    consumers AS (SELECT * FROM (VALUES ('display', 0), ('recorder', 0), ('late', 2)) AS t(consumer, joined))
    SELECT consumer, device, CAST(count(*) AS BIGINT) AS n FROM placed, consumers WHERE slice >= joined GROUP BY consumer, device""",
)
def fan_out_own_pace(spark, sf_dir):
    """Consumers of one landed log with queries of their own; one takes two slices at once, one joins at the third."""
    events, path = fx.table(spark, sf_dir, "events"), work_path(spark, "pace")
    ids = events.agg(F.max("event_id")).first()[0] + 1
    sliced = events.withColumn("slice", F.floor(F.col("event_id") * 4 / ids).cast("int"))
    sliced.repartition("slice").write.partitionBy("slice").parquet(f"{path}/log")

    def table(name):
        return lambda batch, batch_id: write_batch(batch, f"{path}/out/{name}", batch_id)

    wanted = [("display", 1, 0), ("recorder", 2, 0), ("late", 1, 2)]
    consumers = [sinks.Consumer(name, table(name), files, joined) for name, files, joined in wanted]
    for running in sinks.fan_out_log(spark, f"{path}/log", EVENTS_SCHEMA, consumers, f"{path}/checkpoints").values():
        running.awaitTermination()
    rows = [spark.read.parquet(f"{path}/out/{c.name}").select(F.lit(c.name).alias("consumer"), F.col("user_id").alias("device")) for c in consumers]
    return ms.merge_streams(*rows).groupBy("consumer", "device").agg(F.count(F.lit(1)).alias("n"))


@query(
    "notification_sink",
    with_views(
        f"""WITH numbered AS (
          SELECT *, row_number() OVER (PARTITION BY device, date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS rn FROM frames)
        SELECT device AS conn, date_trunc('day', ts) AS window_start, CAST(rn // 5 AS BIGINT) AS batch,
          {fx.UUID_SQL.format('device')} AS client_uuid,
          string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS ids
        FROM numbered GROUP BY device, date_trunc('day', ts), rn // 5""",
        "frames",
    ),
)
def notification_sink(spark, sf_dir):
    """Frames out as framed messages, then decoded as the server would."""
    frames = fx.frames_view(events_stream(spark, sf_dir, delay=WINDOW_DELAY))
    uuid = fx.client_uuid(F.col("device"))
    sent = sinks.notification_sink(frames, work_path(spark, "notify"), uuid, fx.BATCH_SIZE, fx.BATCH_WINDOW, DELAY)
    decoded = ms.decode_messages(sent.withColumn("wire", F.substr(F.col("data"), F.lit(5))))
    frame = "array<struct<ts:string,event_id:bigint,value:double>>"
    ids = F.from_json("body", frame)["event_id"].cast("array<string>")
    return decoded.select("conn", "window_start", "batch", "client_uuid", F.array_join(ids, ",").alias("ids"))

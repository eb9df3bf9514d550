from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framewright.session import shared_dir, work_path
from framewright.sources import image_folders, tables, tensor_records


def test_work_paths_lie_in_the_configured_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert work_path(spark, "x").startswith(shared_dir(spark))


def test_tensor_records_round_trip_over_splits(spark):
    path = work_path(spark, "records")
    tensor_records.register(spark)
    rows = [(bytearray([i % 256, i // 256, 7, 8, 9, 10]), i % 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "data binary, label int").repartition(3)
    df.write.format("tensor_records").mode("append").option("shape", "2x3").save(path)
    back = spark.read.format("tensor_records").option("splitBytes", 60).load(path)
    assert back.rdd.getNumPartitions() >= 100
    assert sorted((bytes(r.data), r.label) for r in back.collect()) == sorted((bytes(d), c) for d, c in rows)
    assert {tuple(r.shape) for r in back.select("shape").distinct().collect()} == {(2, 3)}
    places = back.groupBy("file").agg(F.max("record").alias("m"), F.countDistinct("record").alias("n")).collect()
    assert all(r.m + 1 == r.n for r in places) and len(places) == 3


def test_tensor_records_refuse_wrong_widths(spark):
    tensor_records.register(spark)
    df = spark.createDataFrame([(bytearray(b"abc"), 1)], "data binary, label int")
    with pytest.raises(Exception, match="expected 6"):
        df.write.format("tensor_records").mode("append").option("shape", "2x3").save(work_path(spark, "bad"))


def test_label_map_text(spark, tmp_path):
    (tmp_path / "map.pbtxt").write_text(
        'item {\n  name: "/m/1"\n  id: 1\n  display_name: "person"\n}\n'
        "item { id: 2 display_name: 'a bicycle' }\nitem {\n id: 3\n}\nitem {\n display_name: \"no id\"\n}\n"
        'item {\n  id: 1\n  display_name: "human"\n}\n'
    )
    got = tables.label_map_scan(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "human"), (2, "a bicycle")]


def test_csv_skips_one_header_line_per_file(spark, tmp_path):
    (tmp_path / "iris.csv").write_text("150,4,a,b,c\n5.1,3.5,1.4,0.2,0\n6.0, 2.2,4.0,1.0,1\n")
    got = tables.csv_feature_scan(spark, str(tmp_path / "iris.csv")).collect()
    assert [(r.features, r.label) for r in got] == [([5.1, 3.5, 1.4, 0.2], 0), ([6.0, 2.2, 4.0, 1.0], 1)]


def test_image_folders(spark):
    root = work_path(spark, "img")
    rows = [(c, f"{i}.jpg", bytearray(range(i, i + 6))) for i, c in enumerate(["cat", "dog", "cat"])]
    images = spark.createDataFrame(rows, "label string, name string, data binary")
    assert image_folders.write_image_folders(images, root, 2, 3).count() == 3
    scanned = image_folders.labelled_image_scan(spark, root)
    assert sorted(r.label for r in scanned.collect()) == ["cat", "cat", "dog"]
    decoded = image_folders.decoded_image_scan(spark, root).collect()
    assert sorted((r.label, r.height, r.width, bytes(r.data)) for r in decoded) == sorted(
        (c, 2, 3, bytes(d)) for c, _, d in rows
    )

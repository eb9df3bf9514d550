"""Inputs just outside the fixtures: odd names, null and large keys, broken bytes, empty tables, other zones."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.functions import arrays as ar
from framewright.functions import scalar as sc
from framewright.operators import background as bg
from framewright.operators import dataset as ds
from framewright.operators import detection as de
from framewright.operators import frames as fr
from framewright.operators import handlers as ha
from framewright.operators import messages as ms
from framewright.operators.framing import split_frames
from framewright.operators.ordering import hot_keys, lookup_join, with_group_index
from framewright.sources.tables import label_map_scan, write_label_map


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


NAMES = ["driver's cap", 'a "quoted" one', "braces { in } it", "back\\slash", "id: 9", "plain"]


def test_label_map_round_trip(spark, tmp_path):
    rows = [(i, i, name) for i, name in enumerate(NAMES)]
    write_label_map(table(spark, rows, "pos int, id int, display_name string"), str(tmp_path / "map"))
    found = label_map_scan(spark, str(tmp_path / "map"))
    assert {r.id: r.display_name for r in found.collect()} == dict(enumerate(NAMES))


def test_label_map_written_by_hand(spark, tmp_path):
    text = "item {\n name: '/m/01}'\n id: 1\n display_name: 'it\\'s'\n}\nitem { display_name: \"x\" id: 2 }\nitem { id: 3 }\nitem{id:2 display_name:\"y\"}"
    (tmp_path / "m.pbtxt").write_text(text)
    assert {r.id: r.display_name for r in label_map_scan(spark, str(tmp_path / "m.pbtxt")).collect()} == {1: "it's", 2: "y"}


def test_bad_text_is_a_row(spark):
    wire = [(1, b"\0\0\0\x02ok"), (2, b"\0\0\0\x02\xff\xfe"), (3, b"\0\0\0\x01\0\0\0\x01\xc3"), (4, b"\0\0\0\x02" + b"x" * 100_000), (5, b"\0")]
    out = {r.id: r for r in ms.decode_messages(table(spark, wire, "id int, wire binary")).collect()}
    assert [out[i].error for i in (1, 2, 3, 4, 5)] == [None, "bad text", "bad text", None, "short message"]
    assert (out[1].payload, out[2].payload, len(out[4].payload)) == ("ok", None, 100_000)


def test_eager_merge_of_an_empty_input(spark):
    some = table(spark, [(1, dt.datetime(2024, 1, 1))], "event_id int, ts timestamp_ntz")
    assert ms.merge_streams_eager(some, some.limit(0)).count() == 0
    assert ms.merge_streams_eager(some, some).count() == 2


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_times_need_no_zone(spark, new_york):
    times = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 3, 15), dt.datetime(1969, 12, 31, 23, 59, 59, 5)]
    rows = table(spark, [(1, i, t) for i, t in enumerate(times)], "device int, event_id int, ts timestamp_ntz")
    back = rows.select("ts", sc.micros(F.col("ts")).alias("us"), sc.from_micros(sc.micros(F.col("ts"))).alias("again"))
    epoch = dt.datetime(1970, 1, 1)
    for r in back.collect():
        assert r.us == (r.ts - epoch) // dt.timedelta(microseconds=1) and r.again == r.ts
    paced = fr.throttle(rows.where("event_id < 2"), 1.0, 1).orderBy("event_id").collect()
    assert [r.emit_ts for r in paced] == times[:2]


def test_drop_n(spark):
    rows = table(spark, [(i % 3, i) for i in range(20)], "a int, b int")
    left = [(r.a, r.b) for r in fr.drop_n(rows, 5, "a", "b").orderBy("a", "b").collect()]
    assert left == sorted((i % 3, i) for i in range(20))[5:]
    assert fr.drop_n(rows, 0, "a", "b").count() == 20 and fr.drop_n(rows, 20, "a", "b").count() == 0
    assert fr.drop_n(rows, 50, "a", "b").count() == 0


def test_zero_counts(spark):
    one = table(spark, [(1,)], "x int")
    assert one.select(ar.one_hot(F.col("x"), 0).alias("a"), ar.reshape(F.array("x"), 0, 3).alias("b")).first() == ([], [])
    samples = table(spark, [(i, i % 2) for i in range(10)], "id int, label int")
    assert ds.training_schedule(samples, 4, 0).count() == 0
    steps = ds.training_schedule(samples, 4, 2).orderBy("step").collect()
    assert [r.step for r in steps] == [0, 1, 2, 3] and all(len(set(r.ids)) == 4 for r in steps)


def test_no_labels_no_annotations(spark):
    found = table(spark, [(1, [[0.1, 0.1, 0.2, 0.2]], [0.9], [1.0])], "id int, boxes array<array<double>>, scores array<double>, classes array<double>")
    labels = table(spark, [(2, "two")], "id int, display_name string")
    assert de.annotations(found, labels).first().label == "unknown"
    assert de.annotations(found, labels.limit(0)).count() == 0


def test_samples_without_label_stay(spark):
    rows = table(spark, [(1, "b"), (2, None), (3, "a")], "id int, label string")
    assert {r.id: r.label_idx for r in ds.label_index(rows).collect()} == {1: 1, 2: None, 3: 0}


def test_uuid_parts_are_padded(spark):
    row = table(spark, [("1-1-1-1-1",)], "u string").select(sc.parse_uuid(F.col("u")).alias("u")).first()
    assert row.u == "00000001-0001-0001-0001-000000000001"
    whole = "fedcba98-7654-3210-8000-00000000002a"
    one = table(spark, [(whole,)], "u string")
    high, low = one.select(*sc.longs_from_uuid(F.col("u"))).first()
    assert (high, low) == (0xFEDCBA9876543210 - 2**64, 0x800000000000002A - 2**64)
    assert table(spark, [(high, low)], "a bigint, b bigint").select(sc.uuid_from_longs(F.col("a"), F.col("b"))).first()[0] == whole


def test_motion_keeps_the_frame(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, s), s, bytes([0 if s < 3 else 255] * 8)) for s in range(4)]
    frames = table(spark, rows, "device bigint, ts timestamp_ntz, event_id bigint, data binary")
    moving = bg.motion_frames(frames, 8, 4, threshold=0).orderBy("event_id").collect()
    assert moving and all(bytes(r.data) == rows[r.event_id][3] for r in moving)


BIG = 2**53


def test_connections_beside_a_null_stay_apart(spark):
    """Large neighbouring ids and null ones, whole and split."""
    message = b"\0\0\0\x06\0\0\0\x02ab"
    rows = [(c, i, message[i * 5 : i * 5 + 5]) for c in (BIG, BIG + 1, None) for i in range(2)]
    segments = table(spark, rows, "conn bigint, seq int, data binary")
    for limit in (None, 1):
        found = sorted(((r.conn or 0, r.msg, bytes(r.wire), r.error) for r in split_frames(segments, hot_rows=limit).collect()))
        assert found == [(c, 0, message[4:], None) for c in (0, BIG, BIG + 1)]


def test_handlers_see_whole_keys(spark):
    rows = table(spark, [(c, i) for c in (BIG, BIG + 1, None) for i in range(3)], "conn bigint, i bigint").repartition(3)

    def number(key, pieces):
        n = 0
        for p in pieces:
            yield pd.DataFrame({"conn": [key[0]] * len(p), "i": p["i"], "n": range(n + 1, n + 1 + len(p))})
            n += len(p)

    ordered = ha.handler_process_stream(rows, ["conn"], ["i"], number, "conn bigint, i bigint, n bigint")
    assert sorted((r.conn or 0, r.n) for r in ordered.collect()) == [(c, n) for c in (0, BIG, BIG + 1) for n in (1, 2, 3)]

    def count(p):
        return p.assign(n=1).groupby("conn", as_index=False)["n"].sum()

    def add(p):
        return p.groupby("conn", as_index=False)["n"].sum()

    folded = ha.handler_consume_stream(rows, ["conn"], count, add, "conn bigint, n bigint")
    assert sorted((r.conn or 0, r.n) for r in folded.collect()) == [(c, 3) for c in (0, BIG, BIG + 1)]


def test_resize_in_slices(monkeypatch):
    from framewright.operators import images as im

    monkeypatch.setattr(im, "SLICE", 100)
    rng = np.random.default_rng(1)
    sizes = [(4, 6, 1), (3, 3, 3)] * 5
    data = [rng.integers(0, 256, h * w * c, np.uint8).tobytes() for h, w, c in sizes]
    h, w, c = (pd.Series(x) for x in zip(*sizes, strict=True))
    out = im.resize_bilinear(5, 7).func(h, w, c, pd.Series(data))
    for (a, b, d), raw, got in zip(sizes, data, out, strict=True):
        one = im.bilinear(np.frombuffer(raw, np.uint8).reshape(1, a, b, d).astype(float), 5, 7)
        assert got == one.astype(np.uint8).tobytes()


def test_many_hot_keys_are_all_found(spark):
    """No cap on hot keys: each of 300 is split, also compound ones beyond the largest first parts."""
    rows = spark.range(300 * 12).select((F.col("id") % 300).alias("k"), (F.col("id") % 600).alias("w"), F.col("id"))
    hot = hot_keys(rows, ["k"], 4)
    assert hot.table.count() == 300 and hot.chunks == 901
    assert hot_keys(rows, ["k", "w"], 4).table.count() == 600
    assert hot_keys(rows, ["k"], 12) is None
    index = with_group_index(rows, ["k"], ["id"], hot_rows=4)
    assert index.where((F.col("id") - F.col("k")) / 300 != F.col("idx")).count() == 0
    names = rows.select("k").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    joined = lookup_join(rows, names.where("k % 2 = 0"), "k", "left", hot)
    assert joined.count() == 3600 and joined.where("name is null").count() == 1800

"""Queries for dataset preparation and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions.arrays import argmax
from framewright.operators import dataset as ds
from framewright.operators import metrics as me
from framewright.plans import fixtures as fx
from framewright.plans.fixtures import with_views
from framewright.plans.registry import query

SEED = 42

_SHUFFLED = f"""
    WITH shuffled AS (
      SELECT id, label, row_number() OVER (ORDER BY md5('{SEED}:' || id), id) - 1 AS idx, count(*) OVER () AS n
      FROM samples)"""
_PER_CLASS = f"""
    WITH ranked AS (
      SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || id), id) - 1 AS idx FROM samples),
    smallest AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM samples GROUP BY label)),
    balanced AS (SELECT id, label, CAST(idx AS BIGINT) AS idx, m FROM ranked, smallest WHERE idx < m)"""


@query(
    "class_counts_min",
    with_views(
        """SELECT label, CAST(count(*) AS BIGINT) AS n,
          (SELECT min(c) FROM (SELECT count(*) AS c FROM samples GROUP BY label)) AS n_min
        FROM samples GROUP BY label""",
        "samples",
    ),
)
def class_counts_min(spark, sf_dir):
    return ds.class_counts_min(fx.samples(spark, sf_dir))


@query("balanced_sample", with_views(_PER_CLASS + "SELECT id, label, idx FROM balanced", "samples"))
def balanced_sample(spark, sf_dir):
    return ds.balanced_sample(fx.samples(spark, sf_dir), SEED).select("id", "label", "idx")


PERCENT_SPLIT_SQL = (
    _PER_CLASS
    + """, split AS (SELECT id, label, idx, CASE
      WHEN idx < floor(m * 0.7::DOUBLE) THEN 'train'
      WHEN idx < floor(m * 0.7::DOUBLE) + floor(m * 0.2::DOUBLE) THEN 'validation'
      WHEN idx < floor(m * 0.7::DOUBLE) + floor(m * 0.2::DOUBLE) + floor(m * 0.05::DOUBLE) THEN 'test'
    END AS dataset FROM balanced)"""
)


@query(
    "percent_split",
    with_views(PERCENT_SPLIT_SQL + "SELECT id, label, idx, dataset FROM split WHERE dataset IS NOT NULL", "samples"),
)
def percent_split(spark, sf_dir):
    return ds.percent_split(fx.samples(spark, sf_dir), (70, 20, 5), SEED).select("id", "label", "idx", "dataset")


def _split_sql(size):
    return with_views(
        _SHUFFLED
        + f"""SELECT id, label, CAST(idx AS BIGINT) AS idx,
        CASE WHEN idx < {size} THEN 'train' ELSE 'test' END AS dataset FROM shuffled""",
        "samples",
    )


@query("take_drop_split", _split_sql("120"))
def take_drop_split(spark, sf_dir):
    return ds.take_drop_split(fx.samples(spark, sf_dir), 120, SEED).select("id", "label", "idx", "dataset")


@query("ratio_split", _split_sql("floor(n * 0.67::DOUBLE)"))
def ratio_split(spark, sf_dir):
    return ds.ratio_split(fx.samples(spark, sf_dir), 0.67, SEED).select("id", "label", "idx", "dataset")


@query(
    "balanced_ratio_split",
    with_views(
        _PER_CLASS
        + """SELECT id, label, idx, CASE WHEN idx < floor(m * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS dataset
        FROM balanced""",
        "samples",
    ),
)
def balanced_ratio_split(spark, sf_dir):
    return ds.balanced_ratio_split(fx.samples(spark, sf_dir), 0.7, SEED).select("id", "label", "idx", "dataset")


@query(
    "seeded_shuffle",
    with_views(_SHUFFLED + "SELECT id, label, CAST(idx AS BIGINT) AS idx FROM shuffled", "samples"),
)
def seeded_shuffle(spark, sf_dir):
    return ds.seeded_shuffle(fx.samples(spark, sf_dir), SEED).select("id", "label", "idx")


@query(
    "fixed_batches",
    with_views(
        _SHUFFLED
        + """SELECT CAST(idx // 64 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n,
          string_agg(CAST(id AS VARCHAR), ',' ORDER BY idx) AS ids FROM shuffled GROUP BY idx // 64""",
        "samples",
    ),
)
def fixed_batches(spark, sf_dir):
    batches = ds.fixed_batches(fx.samples(spark, sf_dir), 64, SEED)
    return batches.select("batch", "n", F.array_join(F.col("rows.id").cast("array<string>"), ",").alias("ids"))


@query(
    "training_schedule",
    with_views(
        _SHUFFLED
        + """, batches AS (
          SELECT CAST(idx // 64 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, CAST(min(idx) AS BIGINT) AS first_idx,
            string_agg(CAST(id AS VARCHAR), ',' ORDER BY idx) AS ids
          FROM shuffled WHERE idx // 64 < n // 64 GROUP BY idx // 64)
        SELECT batch, n, first_idx, ids, CAST(epoch AS INTEGER) AS epoch,
          CAST(epoch * (SELECT count(*) // 64 FROM samples) + batch AS BIGINT) AS step
        FROM batches, (SELECT unnest(range(3)) AS epoch)""",
        "samples",
    ),
)
def training_schedule(spark, sf_dir):
    steps = ds.training_schedule(fx.samples(spark, sf_dir), 64, 3, SEED)
    return steps.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(
    "label_index",
    """SELECT event_id, event_type AS label, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS label_idx
    FROM events""",
)
def label_index(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"))
    return ds.label_index(events).select("event_id", "label", "label_idx")


@query(
    "sort_by_name",
    """SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS place
    FROM (SELECT DISTINCT p_name AS name FROM part)""",
)
def sort_by_name(spark, sf_dir):
    names = fx.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return ds.sort_by_name(names, "name")


@query(
    "zip_features_labels",
    with_views(
        """WITH f AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM samples),
          l AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels)
        SELECT CAST(f.pos AS BIGINT) AS pos, id, doc_id, quality FROM f JOIN l ON f.pos = l.pos""",
        "samples",
    ),
)
def zip_features_labels(spark, sf_dir):
    features = fx.samples(spark, sf_dir).select("id")
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return ds.zip_features_labels(features, labels, "id", "doc_id").select("pos", "id", "doc_id", "quality")


def _predictions(spark, sf_dir):
    return fx.logits(spark, sf_dir).select("vec_id", "label", argmax(F.col("logits")).alias("pred"))


@query(
    "accuracy",
    with_views(
        """SELECT round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy,
          CAST(count(*) AS BIGINT) AS n FROM preds""",
        "preds",
    ),
)
def accuracy(spark, sf_dir):
    return me.accuracy(_predictions(spark, sf_dir)).select(F.round("accuracy", 9).alias("accuracy"), "n")


@query(
    "confusion_matrix",
    with_views("SELECT label, pred, CAST(count(*) AS BIGINT) AS n FROM preds GROUP BY label, pred", "preds"),
)
def confusion_matrix(spark, sf_dir):
    return me.confusion_matrix(_predictions(spark, sf_dir))


@query(
    "precision_recall_f1",
    with_views(
        """WITH classes AS (SELECT label AS class FROM preds UNION SELECT pred FROM preds),
        totals AS (
          SELECT class, CAST((SELECT count(*) FROM preds WHERE label = class AND pred = class) AS BIGINT) AS tp,
            CAST((SELECT count(*) FROM preds WHERE label = class) AS BIGINT) AS actual,
            CAST((SELECT count(*) FROM preds WHERE pred = class) AS BIGINT) AS predicted FROM classes)
        SELECT class, tp, actual, predicted,
          round(CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE END, 9) AS "precision",
          round(CASE WHEN actual > 0 THEN tp / actual::DOUBLE END, 9) AS recall,
          round(CASE WHEN actual + predicted > 0 THEN 2 * tp / (actual + predicted)::DOUBLE END, 9) AS f1
        FROM totals""",
        "preds",
    ),
)
def precision_recall_f1(spark, sf_dir):
    scores = me.precision_recall_f1(_predictions(spark, sf_dir))
    return scores.select(
        "class", "tp", "actual", "predicted", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]
    )


@query(
    "dataset_loss",
    with_views(
        """SELECT round(avg(ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))
          - (z[label + 1] - list_max(z))), 9) AS loss FROM logits""",
        "logits",
    ),
)
def dataset_loss(spark, sf_dir):
    return me.dataset_loss(fx.logits(spark, sf_dir)).select(F.round("loss", 9).alias("loss"))

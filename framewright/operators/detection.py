"""From raw detector output to labelled, scaled annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import caption, truncate_product

# Detections must score above the cut; the label of a class without a name; where a caption starts
# from the box corner, in pixels.
SCORE_CUT = 0.5
UNKNOWN = "unknown"
CAPTION_X = 4
CAPTION_Y = 36


def detection_filter(detections: DataFrame, cut: float = SCORE_CUT) -> DataFrame:
    """One row per detection with a score strictly above the cut; ``i`` is its place in the output.

    Input columns ``boxes`` (array of [ymin, xmin, ymax, xmax]), ``scores`` and ``classes``. The
    arrays are filtered before they are exploded, so dropped detections never become rows.
    """
    others = [c for c in detections.columns if c not in ("boxes", "scores", "classes")]
    indexed = F.transform(
        F.arrays_zip("boxes", "scores", "classes"),
        lambda d, i: F.struct(
            i.alias("i"), d["boxes"].alias("box"), d["scores"].alias("score"), d["classes"].alias("class")
        ),
    )
    return detections.select(*others, F.inline(F.filter(indexed, lambda d: d["score"] > cut)))


def label_lookup(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """Class number, truncated to int, to its display name; classes without one are ``unknown``.

    The label side is left to Catalyst: its size decides between broadcast and shuffle.
    """
    names = labels.select(F.col("id").alias("class_id"), F.col("display_name").alias("label"))
    return (
        detections.withColumn("class_id", F.col("class").cast("int"))
        .join(names, "class_id", "left")
        .withColumn("label", F.coalesce("label", F.lit(UNKNOWN)))
    )


def scale_boxes(detections: DataFrame, width: int, height: int) -> DataFrame:
    """Relative box to pixel corners, truncated toward zero."""
    box = F.col("box")
    return detections.withColumns(
        {
            "ymin": truncate_product(box[0], height),
            "xmin": truncate_product(box[1], width),
            "ymax": truncate_product(box[2], height),
            "xmax": truncate_product(box[3], width),
        }
    ).drop("box")


def annotations(
    detections: DataFrame, labels: DataFrame, width: int = 640, height: int = 480, cut: float = SCORE_CUT
) -> DataFrame:
    """What would be drawn on each frame: caption, its anchor and the box corners; nothing without any label."""
    some = labels.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    found = label_lookup(scale_boxes(detection_filter(detections, cut), width, height), labels)
    return (
        found.where(some)
        .withColumn("caption", caption(F.col("label"), F.col("score")))
        .withColumn("text_x", F.col("xmin") + CAPTION_X)
        .withColumn("text_y", F.col("ymin") + CAPTION_Y)
    )

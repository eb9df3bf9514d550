"""Array and image column helpers; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    weights = F.transform(logits, lambda z: F.exp(z - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(weights, lambda w: w / total)


def argmax(values: Column) -> Column:
    """0-based position of the maximum; the first one wins ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """Sparse softmax cross-entropy of one row."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - top))
    return F.log(total) - (F.get(logits, label) - top)


def places(n: int) -> Column:
    """The array 0..n-1; empty for n = 0, where ``sequence`` would count down."""
    return F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")


def one_hot(label: Column, n_classes: int) -> Column:
    return F.transform(places(n_classes), lambda i: (i == label).cast("int"))


def reshape(values: Column, rows: int, width: int) -> Column:
    """A flat array as ``rows`` arrays of ``width`` elements."""
    return F.transform(places(rows), lambda r: F.slice(values, r * width + 1, F.lit(width)))


def flip_horizontal(image: Column) -> Column:
    """Mirror every pixel row of an array of rows."""
    return F.transform(image, F.reverse)


def bgr_to_rgb(pixels: Column) -> Column:
    """Swap the first and third channel of an array of pixels."""
    return F.transform(pixels, lambda p: F.array(p[2], p[1], p[0]))


def scale_pixels(pixels: Column, low: float | Column = 0.0, high: float | Column = 255.0) -> Column:
    """Map ``low..high`` to 0..1."""
    low_c = low if isinstance(low, Column) else F.lit(float(low))
    high_c = high if isinstance(high, Column) else F.lit(float(high))
    return F.transform(pixels, lambda x: (x - low_c) / (high_c - low_c))


def flatten_cast(image: Column, dimensions: int = 2) -> Column:
    """A nested image (rows, columns and perhaps channels) as one float vector."""
    for _ in range(dimensions - 1):
        image = F.flatten(image)
    return image.cast("array<float>")


def count_nonzero(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda x: x != 0))

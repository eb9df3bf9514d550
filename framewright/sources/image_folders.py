"""Image folders: ``<class>/<file>`` trees of encoded images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import open_filesystem


def labelled_image_scan(spark: SparkSession, root: str, pattern: str = "*.jpg") -> DataFrame:
    """Every image below ``root``; its class is the name of its folder."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return files.select("path", _folder("path").alias("label"), "length", "content")


def decoded_image_scan(spark: SparkSession, root: str) -> DataFrame:
    """Every decodable image below ``root`` as height, width, channels and BGR bytes."""
    images = (
        spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(root)
    )
    return images.select(
        F.col("image.origin").alias("path"),
        _folder("image.origin").alias("label"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def _folder(path: str):
    return F.element_at(F.split(F.col(path), "/"), -2)


def png_gray(pixels: np.ndarray) -> bytes:
    """An 8-bit gray image as PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\x00" + row.tobytes() for row in pixels.astype(np.uint8))
    header = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_image_folders(images: DataFrame, root: str, height: int, width: int) -> DataFrame:
    """Write gray images (``label``, ``name``, ``data``) as ``<root>/<label>/<name>``; files are
    written by the tasks. Returns one row per file written, when evaluated."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = open_filesystem(root)
        for batch in batches:
            for label, name, data in zip(batch["label"], batch["name"], batch["data"]):
                folder = f"{base}/{label}"
                filesystem.create_dir(folder, recursive=True)
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width)
                with filesystem.open_output_stream(f"{folder}/{name}") as out:
                    out.write(png_gray(pixels))
            yield batch[["label", "name"]]

    return images.select("label", "name", "data").mapInPandas(write, "label string, name string")

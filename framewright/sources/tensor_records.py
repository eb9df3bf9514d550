"""Fixed-width binary records with a label file beside them, as a Spark data source.

A dataset is a folder of pairs ``<name>.images`` / ``<name>.labels``, both in the IDX layout: a
big-endian magic number (two zero bytes, type code 8 = unsigned byte, number of dimensions), one
int per dimension, then the bytes.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from framewright.session import open_filesystem

SCHEMA = "file string, record bigint, shape array<int>, data binary, label int"
_UBYTE = 8
_BATCH_BYTES = 8 << 20


def idx_header(shape: tuple[int, ...]) -> bytes:
    return struct.pack(f">HBB{len(shape)}I", 0, _UBYTE, len(shape), *shape)


def read_idx_header(stream) -> tuple[tuple[int, ...], int]:
    """Dimensions and header size."""
    zero, code, dims = struct.unpack(">HBB", stream.read(4))
    if zero != 0 or code != _UBYTE:
        raise ValueError("not an IDX file of unsigned bytes")
    return struct.unpack(f">{dims}I", stream.read(4 * dims)), 4 + 4 * dims


class RecordRange(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        super().__init__((name, start, stop))


class TensorRecordReader(DataSourceReader):
    """Splits every file pair into record ranges of about ``splitBytes``."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitBytes", 128 << 20))

    def partitions(self):
        from pyarrow import fs

        filesystem, base = open_filesystem(self.path)
        ranges = []
        for info in sorted(filesystem.get_file_info(fs.FileSelector(base)), key=lambda i: i.path):
            if not info.path.endswith(".images"):
                continue
            with filesystem.open_input_file(info.path) as stream:
                shape, _ = read_idx_header(stream)
            step = max(1, self.split_bytes // int(np.prod(shape[1:], dtype=np.int64)))
            name = info.path[: -len(".images")]
            ranges += [RecordRange(name, i, min(i + step, shape[0])) for i in range(0, shape[0], step)]
        return ranges

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        name, start, stop = partition.value
        filesystem, _ = open_filesystem(self.path)
        with (
            filesystem.open_input_file(f"{name}.images") as images,
            filesystem.open_input_file(f"{name}.labels") as labels,
        ):
            shape, image_header = read_idx_header(images)
            _, label_header = read_idx_header(labels)
            width = int(np.prod(shape[1:], dtype=np.int64))
            step = max(1, _BATCH_BYTES // width)
            for first in range(start, stop, step):
                n = min(step, stop - first)
                images.seek(image_header + first * width)
                labels.seek(label_header + first)
                data = images.read(n * width)
                classes = np.frombuffer(labels.read(n), dtype=np.uint8).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.rsplit("/", 1)[-1]] * n),
                        pa.array(np.arange(first, first + n, dtype=np.int64)),
                        pa.array([list(shape[1:])] * n, type=pa.list_(pa.int32())),
                        pa.array([data[i * width : (i + 1) * width] for i in range(n)], type=pa.binary()),
                        pa.array(classes),
                    ],
                    names=["file", "record", "shape", "data", "label"],
                )


class Written(WriterCommitMessage):
    pass


class TensorRecordWriter(DataSourceArrowWriter):
    """Each task writes its rows (``data``, ``label``) as one file pair of the given shape."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.shape = tuple(int(n) for n in options["shape"].split("x"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, base = open_filesystem(self.path)
        filesystem.create_dir(base, recursive=True)
        name = f"{base}/part-{uuid.uuid4().hex}"
        width = int(np.prod(self.shape, dtype=np.int64))
        count = 0
        # the record count stands in the header, so bodies go first to files of their own
        with (
            filesystem.open_output_stream(f"{name}.images.body") as images,
            filesystem.open_output_stream(f"{name}.labels.body") as labels,
        ):
            for batch in iterator:
                for data in batch.column("data").to_pylist():
                    if len(data) != width:
                        raise ValueError(f"record of {len(data)} bytes, expected {width}")
                    images.write(data)
                labels.write(np.asarray(batch.column("label"), dtype=np.uint8).tobytes())
                count += batch.num_rows
        for kind, shape in (("images", (count, *self.shape)), ("labels", (count,))):
            with (
                filesystem.open_input_file(f"{name}.{kind}.body") as body,
                filesystem.open_output_stream(f"{name}.{kind}.ready") as out,
            ):
                out.write(idx_header(shape))
                while piece := body.read(_BATCH_BYTES):
                    out.write(piece)
            filesystem.delete_file(f"{name}.{kind}.body")
        message = Written()
        message.name, message.count = name, count
        return message

    def commit(self, messages: list[Written | None]) -> None:
        filesystem, _ = open_filesystem(self.path)
        for message in messages:
            if message is None:
                continue
            for kind in ("images", "labels"):
                ready = f"{message.name}.{kind}.ready"
                if message.count:
                    filesystem.move(ready, f"{message.name}.{kind}")
                else:
                    filesystem.delete_file(ready)


class TensorRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensor_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TensorRecordReader:
        return TensorRecordReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TensorRecordWriter:
        return TensorRecordWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TensorRecords)

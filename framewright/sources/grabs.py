"""A streaming source of grabbed frames that goes on where a grab has failed.

A folder holds slices, which are folders themselves; their names rise in the order they land, and a slice is there
once it has a ``_SUCCESS`` file. What a parquet file of a slice holds are grabs. One that cannot be read, or that
does not hold what it should, gives one row of nulls with the fault in ``grab_error``. A file whose bytes cannot be fetched is
no failed grab: the task fails and is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from framewright.session import open_filesystem

ERROR = "grab_error"
#: Name of the counts in a query's progress.
OBSERVED = "grabs"


class GrabbedFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class GrabReader(DataSourceStreamReader):
    """The offset is the name of the last slice read, so a query that is started again goes on behind it."""

    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"]
        self.schema = schema

    def _slices(self) -> list[str]:
        from pyarrow import fs

        filesystem, base = open_filesystem(self.path)
        found = filesystem.get_file_info(fs.FileSelector(base, allow_not_found=True))
        names = [i.base_name for i in found if i.type == fs.FileType.Directory and i.base_name[0] not in "._"]
        landed = filesystem.get_file_info([f"{base}/{n}/_SUCCESS" for n in names])
        return sorted(n for n, i in zip(names, landed, strict=True) if i.type == fs.FileType.File)

    def initialOffset(self) -> dict:
        return {"slice": ""}

    def latestOffset(self) -> dict:
        # a slice that lands behind its neighbour's back would be passed over: names rise as slices land
        return {"slice": max(self._slices(), default="")}

    def partitions(self, start: dict, end: dict) -> list[GrabbedFile]:
        from pyarrow import fs

        filesystem, base = open_filesystem(self.path)
        out = []
        for name in self._slices():
            if start["slice"] < name <= end["slice"]:
                files = filesystem.get_file_info(fs.FileSelector(f"{base}/{name}"))
                out += [GrabbedFile(i.path) for i in sorted(files, key=lambda i: i.path) if i.path.endswith(".parquet")]
        return out

    def read(self, partition: GrabbedFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        filesystem, _ = open_filesystem(self.path)
        wanted = to_arrow_schema(self.schema)
        names = [f.name for f in wanted if f.name != ERROR]
        try:
            with filesystem.open_input_file(partition.value) as stream:
                for batch in pq.ParquetFile(stream).iter_batches(columns=names):
                    missing = [n for n in names if n not in batch.schema.names]
                    if missing:
                        raise pa.ArrowInvalid(f"no column {missing[0]}")
                    yield self._row(wanted, {n: batch.column(n).cast(wanted.field(n).type) for n in names}, batch.num_rows)
        except (pa.ArrowException, OSError) as fault:
            with filesystem.open_input_stream(partition.value) as stream:  # raises if the bytes cannot be fetched
                while stream.read(1 << 20):
                    pass
            yield self._row(wanted, {ERROR: pa.array([f"{type(fault).__name__}: {fault}"[:500]])}, 1)

    @staticmethod
    def _row(wanted: pa.Schema, columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in wanted], schema=wanted)


class FrameGrabs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_grabs"

    def schema(self) -> StructType:
        raise ValueError("frame_grabs needs the schema of the grabs")

    def streamReader(self, schema: StructType) -> GrabReader:
        return GrabReader(schema, self.options)


def frame_grabs(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Unbounded source of the grabs in a folder of slices; failed grabs and empty ones are skipped and counted.

    A grab is empty where a ``required`` column is null. A micro-batch takes all slices that have landed since the last
    one, each file in a task of its own. The counts stand in the query's progress, see ``grab_counts``.
    """
    spark.dataSource.register(FrameGrabs)
    grabs = spark.readStream.format("frame_grabs").schema(f"{schema}, {ERROR} string").option("path", path).load()
    failed, empty = F.col(ERROR).isNotNull(), F.lit(False)
    for name in required:
        empty = empty | F.col(name).isNull()
    counts = {"grabbed": ~failed & ~empty, "empty": ~failed & empty, "failed": failed}
    seen = grabs.observe(OBSERVED, *[F.count_if(c).alias(name) for name, c in counts.items()])
    return seen.where(~failed & ~empty).drop(ERROR)


def grab_counts(query: StreamingQuery) -> dict[str, int]:
    """How many grabs a query took, and how many were empty or failed; without any micro-batch all are zero."""
    total = {"grabbed": 0, "empty": 0, "failed": 0}
    for progress in query.recentProgress:
        seen = progress["observedMetrics"].get(OBSERVED)
        for name in total if seen is not None else ():
            total[name] += (seen if isinstance(seen, dict) else seen.asDict())[name]
    return total

"""A log of sent notifications, as a Spark streaming sink with a commit for each micro-batch.

Each task sends its messages to a draft file. Only when all tasks of a micro-batch have sent theirs does the commit name
the files in the micro-batch's manifest, so a failed send leaves no half batch: its drafts are removed and the
failure is noted. A micro-batch that runs again replaces its manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from framewright.session import open_filesystem

SCHEMA = "conn bigint, window_start timestamp_ntz, batch bigint, data binary"


class SendError(Exception):
    """A message that cannot be sent."""


class Sent(WriterCommitMessage):
    def __init__(self, name: str | None, count: int):
        self.name, self.count = name, count


class NotificationWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        import pyarrow.parquet as pq

        filesystem, base = open_filesystem(self.path)
        filesystem.create_dir(f"{base}/sent", recursive=True)
        name, count, out = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if batch.column("data").null_count:
                    raise SendError("a notification without bytes")
                if out is None:
                    out = pq.ParquetWriter(f"{base}/sent/{name}", batch.schema, filesystem=filesystem)
                out.write_batch(batch)
                count += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                filesystem.delete_file(f"{base}/sent/{name}")
            raise
        if out is None:
            return Sent(None, 0)
        out.close()
        return Sent(name, count)

    def _note(self, folder: str, batch_id: int, what: dict) -> None:
        filesystem, base = open_filesystem(self.path)
        filesystem.create_dir(f"{base}/{folder}", recursive=True)
        draft = f"{base}/{folder}/.{batch_id}.{uuid.uuid4().hex}"
        with filesystem.open_output_stream(draft) as out:
            out.write(json.dumps(what).encode())
        filesystem.move(draft, f"{base}/{folder}/{batch_id:019d}.json")

    def commit(self, messages: list[Sent | None], batchId: int) -> None:  # noqa: N803
        done = [m for m in messages if m is not None and m.name is not None]
        self._note("committed", batchId, {"files": [m.name for m in done], "rows": sum(m.count for m in done)})

    def abort(self, messages: list[Sent | None], batchId: int) -> None:  # noqa: N803
        filesystem, base = open_filesystem(self.path)
        done = [m for m in messages if m is not None]
        for message in done:
            if message.name is not None:
                filesystem.delete_file(f"{base}/sent/{message.name}")
        self._note("failed", batchId, {"tasks_failed": len(messages) - len(done)})


class NotificationLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notification_log"

    def schema(self) -> str:
        return SCHEMA

    def streamWriter(self, schema: StructType, overwrite: bool) -> NotificationWriter:  # noqa: N802
        return NotificationWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NotificationLog)


def _notes(path: str, folder: str) -> dict[int, dict]:
    filesystem, base = open_filesystem(path)
    found = filesystem.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
    out = {}
    for info in found:
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with filesystem.open_input_file(info.path) as note:
                out[int(info.base_name.split(".")[0])] = json.loads(note.read())
    return out


def sent_notifications(spark: SparkSession, path: str) -> DataFrame:
    """What committed micro-batches have sent."""
    files = [f"{path}/sent/{name}" for note in _notes(path, "committed").values() for name in note["files"]]
    return spark.read.schema(SCHEMA).parquet(*files) if files else spark.createDataFrame([], SCHEMA)


def failed_sends(path: str) -> dict[int, int]:
    """How many tasks of a micro-batch failed to send, at its last failure."""
    return {batch_id: note["tasks_failed"] for batch_id, note in _notes(path, "failed").items()}

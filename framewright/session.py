"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "framewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the session's ``spark.checkpoint.dir``. Only a local session without one gets a folder
    of its own; on a cluster a missing setting is an error, since a machine-local folder would be
    lost with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="framewright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_filesystem(path: str):
    """The Arrow filesystem of a path or URI and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if path.split("/", 1)[0].endswith(":") else f"file://{path}")


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so partition-dependent columns become data."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped_to: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped_to:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    staging = tempfile.mkdtemp(prefix="framewright-zip-")
    archive = shutil.make_archive(f"{staging}/framewright", "zip", root, "framewright")
    sc.addPyFile(archive)
    _shipped_to.add(sc.applicationId)

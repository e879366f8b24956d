"""Cutting lineage: tables that are used more than once are written once."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []
_after: list[Callable[[], object]] = []


def at_release(forget: Callable[[], object]) -> None:
    """What is to be done once the tables are gone: whoever holds some forgets them."""
    _after.append(forget)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, which all executors share.

    A local folder is made only where none is set and the session runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="keelson-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df, written as Parquet to the folder that all executors share, and read back.

    Readers prune its columns, know its size, and do not compute df again when executors are lost.
    """
    path = f"{shared_folder(df.sparkSession)}/keelson-{uuid.uuid4().hex}"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")  # nothing reads the exchanges of a table that is written
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    if not _written:
        atexit.register(release)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, file: Path) -> str:
    """A local file's copy in the folder that all executors share; release() deletes it."""
    path = f"{shared_folder(spark)}/keelson-{uuid.uuid4().hex}"
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    target.getFileSystem(conf).copyFromLocalFile(hadoop.Path(f"file://{file}"), target)
    if not _written:
        atexit.register(release)
    _written.append(path)
    return path


def release(spark: SparkSession | None = None) -> None:
    """Deletes what cut() has written in this process."""
    while _after:
        _after.pop()()
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    while _written:
        path = hadoop.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)

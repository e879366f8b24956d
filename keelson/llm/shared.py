"""What several operators of this subpackage need: durable tables and text rules."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import shared_folder

#: The white space of every contract here: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"\x20\x09-\x0D"

_written: list[str] = []


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage: what comes after survives lost executors without computing df
    again, and reads df as often as it likes. release() deletes such tables.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/keelson-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    if not _written:
        atexit.register(release)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._keelson_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = hadoop.Path(path)
    path.getFileSystem(conf).delete(path, True)


def discard(table: DataFrame) -> None:
    """Deletes a table of materialise() that nothing reads any more."""
    if table._keelson_path in _written:
        _written.remove(table._keelson_path)
        _delete(table.sparkSession, table._keelson_path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def release(spark: SparkSession | None = None) -> None:
    """Deletes the tables that materialise() has written in this process."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    while _written:
        _delete(spark, _written.pop())


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs without white space in the text, null counting as empty."""
    marked = F.regexp_replace(whole(text), f"[^{SPACE}]+", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def unit_interval(key: Column) -> Column:
    """A number in [0, 1) that depends on the string key alone: 52 bits of its SHA-256."""
    bits = F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(float(2**52))

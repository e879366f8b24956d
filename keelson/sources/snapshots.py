"""Snapshots of a table that are swapped in whole: readers see the old one or the new one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

BASELINE = "project string, fp string, rule string, from_id string, to_id string, note string"
_CURRENT = "CURRENT"


class Snapshots:
    """A folder of Parquet snapshots and a file that names the current one.

    A snapshot is written to a folder of its own; then the name is replaced by a rename, which the
    file system does at once. What was current before is deleted by prune().
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str = BASELINE):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _fs(self):
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        path = hadoop.Path(self.folder)
        return hadoop, path.getFileSystem(conf), hadoop.FileContext.getFileContext(path.getFileSystem(conf).getUri(), conf)

    def current(self) -> str | None:
        """The folder of the current snapshot, None before the first."""
        hadoop, fs, _ = self._fs()
        if not fs.exists(hadoop.Path(f"{self.folder}/{_CURRENT}")):
            return None
        return f"{self.folder}/{self.spark.read.text(f'{self.folder}/{_CURRENT}').first()[0]}"

    def read(self) -> DataFrame:
        """The current snapshot, an empty table before the first."""
        at = self.current()
        return self.spark.createDataFrame([], self.schema) if at is None else self.spark.read.schema(self.schema).parquet(at)

    def write(self, table: DataFrame) -> None:
        """Makes table the current snapshot; it may have been computed from the one before."""
        name = f"v-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.folder}/{name}")
        hadoop, fs, files = self._fs()
        new = hadoop.Path(f"{self.folder}/{_CURRENT}-{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray(name.encode()))
        out.close()
        rename = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files.rename(new, hadoop.Path(f"{self.folder}/{_CURRENT}"), how)

    def prune(self) -> None:
        """Deletes all snapshots but the current one."""
        hadoop, fs, _ = self._fs()
        kept = self.current()
        for status in fs.listStatus(hadoop.Path(self.folder)):
            name = status.getPath().getName()
            if name.startswith("v-") and f"{self.folder}/{name}" != kept:
                fs.delete(status.getPath(), True)

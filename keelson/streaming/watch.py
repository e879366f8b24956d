"""Watching files: fingerprints of a listing, quiet batches, versions that keep the last good state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Seconds between polls, and the folders that are not watched.
POLL_SECONDS = 0.25
SKIPPED = r"(^|/)(\.[^/]+|target|node_modules)/"
WATCHED = r"(\.rs|(^|/)Cargo\.toml|(^|/)architecture\.toml)$"


def listing_fingerprint(files: DataFrame) -> DataFrame:
    """project, fingerprint of a listing (project, path, length, modified) of what is watched."""
    kept = files.where(F.col("path").rlike(WATCHED) & ~F.col("path").rlike(SKIPPED))
    own = F.xxhash64("path", "length", F.col("modified").cast("string"))  # of each file; their order is of no matter
    return kept.groupBy("project").agg(F.xxhash64(F.bit_xor(own), F.sum(F.shiftrightunsigned(own, 24)), F.count("*")).alias("fingerprint"))


def quiet_batches(changes: DataFrame, quiet_seconds: float) -> DataFrame:
    """key, batch, first_ts, last_ts, n for changes (key, ts, ord): changes closer than
    quiet_seconds belong together; a batch is over after that much quiet."""
    order = W.partitionBy("key").orderBy("ts", "ord")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(order))
    new = F.when(gap <= int(quiet_seconds * 1_000_000), 0).otherwise(1)
    numbered = changes.withColumn("_new", new).withColumn("batch", F.sum("_new").over(order))
    return numbered.groupBy("key", "batch").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def versions(attempts: DataFrame) -> DataFrame:
    """attempts (key, ord, error or null, …) with seq (each one) and version (each success).

    A failure keeps the version and sets the error; the next success clears it.
    """
    so_far = W.partitionBy("key").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return attempts.withColumns({"seq": F.count("*").over(so_far), "version": F.count_if(F.col("error").isNull()).over(so_far)})


def debounce(polls: DataFrame, key: str = "project", mark: str = "fingerprint") -> DataFrame:
    """Streaming: key, fingerprint each time a changed fingerprint was followed by one quiet poll.

    polls is a stream of (key, fingerprint, seq), several rows of a key in one batch being taken
    in order of seq. The state of a key is what was last reported and what is pending.
    """

    def step(keys: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reported, pending = state.get if state.exists else (None, None)
        out = []
        for part in rows:
            for now in part.sort_values("seq")[mark]:
                now = int(now)
                if now == pending and now != reported:
                    reported = now
                    out.append(now)
                pending = now
        state.update((reported, pending))
        yield pd.DataFrame({key: [keys[0]] * len(out), mark: out})

    return polls.groupBy(key).applyInPandasWithState(step, f"{key} string, {mark} bigint", "reported bigint, pending bigint", "append", "NoTimeout")


class LastGood:
    """A foreachBatch sink: rebuilds on each batch, and keeps what was good when that fails.

    Each batch appends (seq, version, error) to the table `log`; a success writes its result to
    `out`/version=n before the log says so, so readers of the log never meet a half-written one.
    A batch that the log holds is passed over, so that batches played again count once.
    """

    def __init__(self, spark: SparkSession, build: Callable[[DataFrame], DataFrame], out: str, log: str):
        self.spark, self.build, self.out, self.log = spark, build, out, log

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("batch bigint, seq bigint, version bigint, error string").parquet(self.log)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def state(self) -> tuple[int, int]:
        """(seq, version) of the last batch."""
        log = self._log()
        row = log.agg(F.max("seq"), F.max("version")).first() if log is not None else (0, 0)
        return row[0] or 0, row[1] or 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        log = self._log()
        if log is not None and not log.where(F.col("batch") == batch_id).isEmpty():
            return  # played again after a restart: it has been counted
        seq, version = self.state()
        error = None
        try:
            self.build(batch).write.mode("overwrite").parquet(f"{self.out}/version={version + 1}")
            version += 1
        except Exception as failure:
            error = str(failure).splitlines()[0][:500]
        self.spark.createDataFrame([(batch_id, seq + 1, version, error)], "batch bigint, seq bigint, version bigint, error string").write.mode("append").parquet(self.log)

    def current(self) -> DataFrame:
        """The last good result."""
        return self.spark.read.parquet(f"{self.out}/version={self.state()[1]}")


def listing(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """project, path, length, modified of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.lit(project).alias("project"), "path", "length", F.col("modificationTime").alias("modified"))

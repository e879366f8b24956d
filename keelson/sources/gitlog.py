"""Commit histories: the text of `git log --numstat`, and the command that makes it."""

from __future__ import annotations

import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import number_or_zero
from ..plans.lineage import put
from ..schema import COMMIT_FILES

#: Marks that no path holds: one ahead of each commit, one between the fields of its first line.
RECORD, FIELD = "\x02", "\x01"
FORMAT = "%x02%H%x01%an%x01%ad"


def records(logs: DataFrame) -> DataFrame:
    """project, ord, commit from logs (project, text): the text is cut at the marks of commits."""
    cut = logs.select("project", F.posexplode(F.split("text", RECORD)).alias("ord", "commit"))
    return cut.where("ord > 0").withColumn("ord", F.col("ord").cast("bigint"))


def read_records(spark: SparkSession, path: str, project: str) -> DataFrame:
    """project, ord, commit from files of logs. The mark of commits separates the records that Spark
    reads, so a log of any size is split among tasks; ord grows along each file."""
    lines = spark.read.option("lineSep", RECORD).text(path)
    return lines.where("value != ''").select(F.lit(project).alias("project"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("commit"))


def parse(commits: DataFrame, prefix: str = "") -> DataFrame:
    """commit_files from commits (project, ord, commit): each has its first line and its files.

    A binary file's `-` counts as 0; prefix, the folder of the project in its repository, is cut
    off, and files outside of it are left out. No row needs another, so nothing is shuffled.
    """
    lines = F.split("commit", "\n")
    head = lambda i: F.split_part(lines[0], F.lit(FIELD), F.lit(i))
    cell = lambda i: F.split_part("line", F.lit("\t"), F.lit(i))
    files = commits.select("project", "ord", head(1).alias("hash"), head(2).alias("author"), head(3).alias("date"), F.posexplode(lines).alias("n", "line")).where("n > 0 and line != ''")
    out = files.select("project", (F.col("ord") * (1 << 20) + F.col("n")).alias("ord"), "hash", "author", "date", cell(3).alias("path"), number_or_zero(cell(1)).alias("added"), number_or_zero(cell(2)).alias("removed")).where("path != ''")
    if prefix:
        out = out.where(F.startswith("path", F.lit(prefix))).withColumn("path", F.substr("path", F.lit(len(prefix) + 1)))
    return out


def run(folder: str, out: Path) -> str:
    """Writes the log of the commits that touch folder to the file `out`; why there is none, or an empty string."""
    command = ["git", "-C", folder, "log", "--no-merges", "--numstat", "--relative", f"--format={FORMAT}", "--date=short", "--", "."]
    try:
        with out.open("wb") as sink:
            done = subprocess.run(command, stdout=sink, stderr=subprocess.PIPE, check=False)
    except OSError as failure:
        return f"git could not be run: {failure}"
    if done.returncode:
        return f"git log failed: {(done.stderr.decode(errors='replace').strip().splitlines() or ['no message'])[0]}"
    return "" if out.stat().st_size > 1 else "no commit touches this folder"


def read(spark: SparkSession, folder: str, project: str) -> tuple[DataFrame, str]:
    """(commit_files, reason) of a folder under git; an empty table where there is no history.

    The log goes to a file in the folder that all executors share and is read from there."""
    with tempfile.TemporaryDirectory() as local:
        log = Path(local) / "log"
        reason = run(folder, log)
        if reason:
            return spark.createDataFrame([], COMMIT_FILES), reason
        return parse(read_records(spark, put(spark, log), project)), ""

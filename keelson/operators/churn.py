"""Churn of files over a commit history, and where it meets dependents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import churn_score

#: Below this many commits nothing is ranked.
MIN_COMMITS = 20


def per_file(commit_files: DataFrame) -> DataFrame:
    """project, path, commits (touches), added, removed, first, last, authors.

    first and last go by position in the log, newest first; they are dates only by consequence.
    """
    return commit_files.groupBy("project", "path").agg(
        F.count("*").alias("commits"),
        F.sum("added").alias("added"),
        F.sum("removed").alias("removed"),
        F.max_by("date", "ord").alias("first"),
        F.min_by("date", "ord").alias("last"),
        F.countDistinct("author").alias("authors"),
    )


def window(commit_files: DataFrame) -> DataFrame:
    """project, since, commits (distinct), files."""
    return commit_files.groupBy("project").agg(F.min("date").alias("since"), F.countDistinct("hash").alias("commits"), F.countDistinct("path").alias("files"))


def availability(commit_files: DataFrame) -> DataFrame:
    """project, available, enough, reason: whether the history may be ranked."""
    w = window(commit_files)
    enough = F.col("commits") >= MIN_COMMITS
    short = F.concat(F.col("commits").cast("string"), F.lit(f" of {MIN_COMMITS} commits that a ranking needs"))
    return w.select("project", (F.col("commits") > 0).alias("available"), enough.alias("enough"), F.when(~enough, short).otherwise("").alias("reason"))


def dependents(links: DataFrame, modules: DataFrame) -> DataFrame:
    """project, path, deps: links whose target module lies in the file."""
    files = modules.select("project", F.col("id").alias("b"), F.col("file").alias("path"))
    return links.join(files, ["project", "b"]).groupBy("project", "path").agg(F.count("*").alias("deps"))


def scored(churn: DataFrame, deps: DataFrame) -> DataFrame:
    """churn with deps (0 without any) and score = commits * (1 + deps)."""
    out = churn.join(deps, ["project", "path"], "left").withColumn("deps", F.coalesce("deps", F.lit(0).cast("bigint")))
    return out.withColumn("score", churn_score(F.col("commits"), F.col("deps")))


def _over_all(files: DataFrame, **totals) -> DataFrame:
    """files with totals of their project: a small aggregate joined back, not a window."""
    return files.join(files.groupBy("project").agg(*[x.alias(k) for k, x in totals.items()]), "project")


def hotspots(files: DataFrame) -> DataFrame:
    """Files with a tenth of the largest churn and more than an even share of all."""
    out = _over_all(files, _max=F.max("commits"), _n=F.count("*"), _sum=F.sum("commits"))
    return out.where("commits * 10 >= _max and commits * _n > _sum").drop("_max", "_n", "_sum")


def depended_upon(files: DataFrame) -> DataFrame:
    """Files with a tenth of the most dependents; none if there are no dependents."""
    return _over_all(files, _max=F.max("deps")).where("_max > 0 and deps * 10 >= _max").drop("_max")


def top_fraction(files: DataFrame, n: int) -> DataFrame:
    """Files whose score is at least 1/n of the largest (a share of the maximum, no percentile)."""
    return _over_all(files, _max=F.max("score")).where(F.col("_max") > 0).where(F.col("score") * n >= F.col("_max")).drop("_max")


def concentration(files: DataFrame) -> DataFrame:
    """Hotspots that much depends upon, with their share of all churn in percent."""
    hot = hotspots(files).select("project", "path")
    leaned = depended_upon(files).select("project", "path")
    total = _over_all(files, _sum=F.sum("commits"))
    both = total.join(hot, ["project", "path"], "left_semi").join(leaned, ["project", "path"], "left_semi")
    return both.select("project", "path", "commits", "deps", (F.lit(100.0) * F.col("commits") / F.col("_sum")).alias("share"))


def ranked(files: DataFrame, metric: str = "score", k: int = 40) -> DataFrame:
    """The k files with the largest metric, with rank; ties by path."""
    order = W.partitionBy("project").orderBy(F.desc(metric), "path")
    return files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(files: DataFrame, query: str, columns: tuple[str, ...] = ("path",)) -> DataFrame:
    """Files that hold the query in one of the columns, whatever the case."""
    return files.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))

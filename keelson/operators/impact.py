"""What a set of changes reaches, and the risks it meets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def reverse_reach(changed: DataFrame, links: DataFrame) -> DataFrame:
    """project, node, depth, direct: who depends on the changed nodes."""
    return graph.dependents_of(changed, links).withColumn("direct", F.col("depth") == 1)


def affected_surfaces(hops: DataFrame, entry_files: DataFrame, changed: DataFrame) -> DataFrame:
    """project, start, via: entries whose trace (project, start, node) or own node is changed (project, id)."""
    ids = changed.select("project", F.col("id").alias("node")).distinct()
    through = hops.join(ids, ["project", "node"], "left_semi").groupBy("project", "start").agg(F.min("node").alias("via"))
    own = entry_files.select("project", F.col("id").alias("start"), F.col("id").alias("node")).join(ids, ["project", "node"], "left_semi").select("project", "start", F.col("node").alias("via"))
    return through.unionByName(own).groupBy("project", "start").agg(F.min("via").alias("via"))


def risk_crossings(changed: DataFrame, ranked: DataFrame, coupled: DataFrame, tested: DataFrame) -> DataFrame:
    """project, path, rank, missing, tested: for changed files (project, path) their hotspot rank,
    the files that usually change with them but did not, and whether a test reaches them."""
    files = changed.select("project", "path").distinct()
    pairs = coupled.select("project", F.col("a").alias("path"), F.col("b").alias("other")).unionByName(coupled.select("project", F.col("b").alias("path"), F.col("a").alias("other")))
    absent = pairs.join(files, ["project", "path"], "left_semi").join(files.select("project", F.col("path").alias("other")), ["project", "other"], "left_anti")
    missing = absent.groupBy("project", "path").agg(F.sort_array(F.collect_set("other")).alias("missing"))
    out = files.join(ranked.select("project", "path", "rank"), ["project", "path"], "left").join(missing, ["project", "path"], "left")
    out = out.join(tested.select("project", "path", F.lit(True).alias("_t")).distinct(), ["project", "path"], "left")
    return out.select("project", "path", "rank", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.coalesce("_t", F.lit(False)).alias("tested"))

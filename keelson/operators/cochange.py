"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .churn import MIN_COMMITS

MAX_FILES, MIN_CHANGES, MIN_DEGREE = 25, 5, 0.3


def trusted_commits(commit_files: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """project, hash, path: distinct files of commits that touch at most max_files of them."""
    files = commit_files.select("project", "hash", "path").distinct()
    small = files.groupBy("project", "hash").agg(F.count("*").alias("n")).where(F.col("n") <= max_files)
    return files.join(small.select("project", "hash"), ["project", "hash"], "left_semi")


def excluded_commits(commit_files: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """project, commits, excluded."""
    sizes = commit_files.groupBy("project", "hash").agg(F.countDistinct("path").alias("n"))
    return sizes.groupBy("project").agg(F.count("*").alias("commits"), F.count_if(F.col("n") > max_files).alias("excluded"))


def pairs(commit_files: DataFrame, max_files: int = MAX_FILES, min_changes: int = MIN_CHANGES, min_degree: float = MIN_DEGREE) -> DataFrame:
    """project, a, b, together, degree, a_to_b, b_to_a for pairs a < b.

    Both files must change at least min_changes times in trusted commits; degree is Jaccard's,
    the other two are the confidence in each direction. A commit makes at most max_files^2 / 2
    pairs, so the pairing is linear in the commits.
    """
    files = trusted_commits(commit_files, max_files)
    often = files.groupBy("project", "path").agg(F.count("*").alias("n")).where(F.col("n") >= min_changes)
    lists = files.join(often.select("project", "path"), ["project", "path"], "left_semi").groupBy("project", "hash").agg(F.sort_array(F.collect_list("path")).alias("f"))
    both = F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.greatest(F.size("f") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    met = lists.where(F.size("f") > 1).select("project", F.explode(both).alias("p")).groupBy("project", "p.a", "p.b").agg(F.count("*").alias("together"))
    na = often.select("project", F.col("path").alias("a"), F.col("n").alias("na"))
    nb = often.select("project", F.col("path").alias("b"), F.col("n").alias("nb"))
    out = met.join(na, ["project", "a"]).join(nb, ["project", "b"])
    t = F.col("together")
    out = out.select("project", "a", "b", "together", (t / (F.col("na") + F.col("nb") - t)).alias("degree"), (t / F.col("na")).alias("a_to_b"), (t / F.col("nb")).alias("b_to_a"))
    return out.where(F.col("degree") >= min_degree)


def unexplained(coupled: DataFrame, links: DataFrame, modules_of: DataFrame | None = None) -> DataFrame:
    """Coupled pairs without a link in either direction; links are (project, a, b) of files.

    With modules_of (project, path, module) they are told whether they cross modules."""
    either = links.select("project", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = coupled.join(either, ["project", "a", "b"], "left_anti")
    if modules_of is None:
        return out
    side = lambda end: modules_of.select("project", F.col("path").alias(end), F.col("module").alias(f"_{end}"))
    out = out.join(side("a"), ["project", "a"], "left").join(side("b"), ["project", "b"], "left")
    return out.withColumn("cross_module", ~F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")


def status(commit_files: DataFrame, links: DataFrame, max_files: int = MAX_FILES, min_changes: int = MIN_CHANGES, min_degree: float = MIN_DEGREE) -> DataFrame:
    """project, status, because, n: whether coupling is explained by links, as far as the history tells.

    `unevaluable` with fewer than MIN_COMMITS trusted commits or no file with min_changes of them,
    `violated` if there are pairs without a link, else `pass`.
    """
    files = trusted_commits(commit_files, max_files)
    known = commit_files.select("project").distinct()
    commits = files.groupBy("project").agg(F.countDistinct("hash").alias("_commits"))
    often = files.groupBy("project", "path").agg(F.count("*").alias("n")).where(F.col("n") >= min_changes).groupBy("project").agg(F.count("*").alias("_often"))
    pair = unexplained(pairs(commit_files, max_files, min_changes, min_degree), links).groupBy("project").agg(F.count("*").alias("_pairs"))
    out = known.join(commits, "project", "left").join(often, "project", "left").join(pair, "project", "left").na.fill(0)
    because = F.when(F.col("_commits") < MIN_COMMITS, F.concat(F.col("_commits").cast("string"), F.lit(f" of {MIN_COMMITS} commits that coupling needs"))).when(
        F.col("_often") == 0, F.lit(f"no file changes {min_changes} times")
    )
    state = F.when(because.isNotNull(), "unevaluable").when(F.col("_pairs") > 0, "violated").otherwise("pass")
    return out.select("project", state.alias("status"), F.coalesce(because, F.lit("")).alias("because"), F.when(state == "violated", F.col("_pairs")).otherwise(0).cast("bigint").alias("n"))


def design_matrix(coupled: DataFrame, modules_of: DataFrame) -> DataFrame:
    """project, ma, mb, pairs, together: coupling summed by unordered pair of modules."""
    ma = modules_of.select("project", F.col("path").alias("a"), F.col("module").alias("x"))
    mb = modules_of.select("project", F.col("path").alias("b"), F.col("module").alias("y"))
    placed = coupled.join(ma, ["project", "a"]).join(mb, ["project", "b"])
    return placed.groupBy("project", F.least("x", "y").alias("ma"), F.greatest("x", "y").alias("mb")).agg(F.count("*").alias("pairs"), F.sum("together").alias("together"))

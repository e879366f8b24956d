"""The violation ratchet: fingerprints, snapshots that are compared, accepted progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fingerprint, ratio


def gates(kind: str = "kind", gate: str = "gate", status: str = "status") -> Column:
    """Whether a violation may change the exit code."""
    return F.col(gate) & (F.col(kind) == "decidable") & (F.col(status) != "delegated")


def current(findings: DataFrame, instances: DataFrame) -> DataFrame:
    """project, fp, rule, from_id, to_id: violated gating rules' instances, one for each fingerprint."""
    active = findings.where("status = 'violated'").where(gates()).select("project", "rule")
    hit = instances.join(active, ["project", "rule"], "left_semi").withColumn("to_id", F.coalesce("to_id", F.lit("")))
    return hit.select("project", fingerprint(F.col("rule"), F.col("from_id"), F.col("to_id")).alias("fp"), "rule", "from_id", "to_id").dropDuplicates(["project", "fp"])


def excluded(findings: DataFrame) -> DataFrame:
    """project, rule, reason for violated rules that do not enter the baseline."""
    reason = F.when(F.col("kind") == "heuristic", "heuristic").when(F.col("status") == "delegated", "delegated").when(~F.col("gate"), "advisory")
    return findings.where("status in ('violated', 'delegated')").withColumn("reason", reason).where("reason is not null").select("project", "rule", "reason")


def diff(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """project, fp, rule, from_id, to_id, note, state: new, known (note kept) or fixed."""
    n, b = now.alias("n"), baseline.alias("b")
    both = n.join(b, ["project", "fp"], "full_outer")
    pick = lambda c: F.coalesce(f"n.{c}", f"b.{c}").alias(c)
    state = F.when(F.col("b.rule").isNull(), "new").when(F.col("n.rule").isNull(), "fixed").otherwise("known")
    return both.select("project", "fp", pick("rule"), pick("from_id"), pick("to_id"), F.coalesce("b.note", F.lit("")).alias("note"), state.alias("state"))


def update(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """The new baseline: what is violated now, with the notes that were kept."""
    notes = baseline.select("project", "fp", "note")
    return now.join(notes, ["project", "fp"], "left").withColumn("note", F.coalesce("note", F.lit("")))


def dropped_notes(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Noted entries of the baseline that are violated no more."""
    return baseline.where("note != ''").join(now.select("project", "fp"), ["project", "fp"], "left_anti")


def progress(series: DataFrame, today: DataFrame) -> DataFrame:
    """series (project, ord, at, violations, coverage) with today's (project, at, violations,
    coverage): it replaces the last entry if that is of the same day, else it is appended."""
    last = series.groupBy("project").agg(F.max_by(F.struct("ord", "at"), "ord").alias("last"))
    joined = today.join(last, "project", "left")
    same = F.coalesce(F.col("last.at") == F.col("at"), F.lit(False))
    row = joined.select("project", F.when(same, F.col("last.ord")).otherwise(F.coalesce(F.col("last.ord"), F.lit(-1)) + 1).cast("bigint").alias("ord"), "at", "violations", "coverage")
    kept = series.join(row.select("project", "ord"), ["project", "ord"], "left_anti")
    return kept.select("project", F.col("ord").cast("bigint"), "at", "violations", "coverage").unionByName(row)


def counts(findings: DataFrame) -> DataFrame:
    """project, upheld, violated, unevaluable, passing (with delegated)."""
    return findings.groupBy("project").agg(
        F.count_if(F.col("status") == "upheld").alias("upheld"), F.count_if(F.col("status") == "violated").alias("violated"),
        F.count_if(F.col("status") == "unevaluable").alias("unevaluable"), F.count_if(F.col("status").isin("pass", "delegated")).alias("passing"),
    )


def totals(findings: DataFrame) -> DataFrame:
    """project, violations (instances, 1 at least for a violated rule), gating_failures, rules."""
    violated = F.col("status") == "violated"
    return findings.groupBy("project").agg(
        F.coalesce(F.sum(F.when(violated, F.greatest("n", F.lit(1)))), F.lit(0)).cast("bigint").alias("violations"), F.count_if(violated & gates()).alias("gating_failures"), F.count("*").alias("rules")
    )


def enforcement(findings: DataFrame) -> DataFrame:
    """project, bucket, n: compiler, checked-here, clippy, advisory; disjoint, all rules."""
    bucket = F.when(~gates(), "advisory").when(F.col("tier") == "compiler", "compiler").when(F.col("tier") == "clippy", "clippy").otherwise("checked-here")
    return findings.groupBy("project", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def exit_codes(state: DataFrame, allow_new: int = 0) -> DataFrame:
    """project, new, exit_code: 1 if there are more new violations than allowed."""
    return state.groupBy("project").agg(F.count_if(F.col("state") == "new").alias("new")).withColumn("exit_code", F.when(F.col("new") > allow_new, 1).otherwise(0))


def delta(series: DataFrame, today: DataFrame) -> DataFrame:
    """project, violations, coverage: today's less the last accepted entry's."""
    last = series.groupBy("project").agg(F.max_by(F.struct("violations", "coverage"), "ord").alias("last"))
    return today.join(last, "project").select("project", (F.col("violations") - F.col("last.violations")).alias("violations"), (F.col("coverage") - F.col("last.coverage")).alias("coverage"))


def locate(entries: DataFrame, instances: DataFrame) -> DataFrame:
    """entries with file, line and detail of the first instance of the same rule and ends."""
    key = ["project", "rule", "from_id", "to_id"]
    found = instances.withColumn("to_id", F.coalesce("to_id", F.lit(""))).groupBy(*key).agg(F.min(F.struct("file", "line", "detail")).alias("at"))
    return entries.join(found, key, "left").select(*entries.columns, "at.*")


def attributed(state: DataFrame, changed: DataFrame, instances: DataFrame) -> DataFrame:
    """state's new and fixed entries with cause: changed code, or a difference of the scan."""
    placed = locate(state.where("state != 'known'"), instances)
    touched = changed.select("project", F.col("path").alias("file"), F.lit(True).alias("_touched")).distinct()
    return placed.join(touched, ["project", "file"], "left").withColumn("cause", F.when(F.coalesce("_touched", F.lit(False)), "changed-code").otherwise("scan-difference")).drop("_touched")


def fold_renames(state: DataFrame) -> DataFrame:
    """project, rule, fixed_fp, new_fp: pairs of fixed and new entries whose ends differ only in
    their module prefix; each entry is in one pair at most, matched in order of fingerprint."""
    key = ["project", "rule", "_from", "_to"]
    ends = state.withColumns({"_from": F.substring_index("from_id", "::", -1), "_to": F.substring_index("to_id", "::", -1)})
    nth = F.row_number().over(W.partitionBy(*key).orderBy("fp"))
    old = ends.where("state = 'fixed'").select(*key, F.col("fp").alias("fixed_fp"), nth.alias("_n"))
    new = ends.where("state = 'new'").select(*key, F.col("fp").alias("new_fp"), nth.alias("_n"))
    return old.join(new, [*key, "_n"]).select("project", "rule", "fixed_fp", "new_fp")


def coverage_row(coverage: DataFrame) -> DataFrame:
    return coverage.select("project", (ratio(F.col("classified"), F.col("total")) * 100).alias("coverage"))

"""Checks for use in a test suite: each returns quietly or raises with a report.

All of them look at every project of their tables at once; what they collect is what a report
shows, at most SHOWN rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import classify, ratchet
from .rules import RULES, Evaluation

SHOWN = 50


class ArchitectureError(AssertionError):
    """What a check found."""


def gating_rules() -> tuple[str, ...]:
    """Ids of the rules that may change an exit code."""
    return tuple(r.id for r in RULES if r.gate and r.kind == "decidable")


def gating_new(state: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """project, n: new entries of the gating rules (or of those named), 0 where there are none."""
    hit = (F.col("state") == "new") & F.col("rule").isin(*(gating_rules() if rules is None else rules))
    return state.groupBy("project").agg(F.count_if(hit).alias("n"))


def _fail(title: str, rows: DataFrame, line) -> None:
    found = rows.limit(SHOWN + 1).collect()
    if found:
        more = ["  …"] if len(found) > SHOWN else []
        raise ArchitectureError("\n".join([title, *[f"  {line(r)}" for r in found[:SHOWN]], *more]))


class Checks:
    """Checks of one evaluation against a baseline (project, fp, rule, from_id, to_id, note)."""

    def __init__(self, evaluation: Evaluation, baseline: DataFrame):
        self.evaluation, self.baseline = evaluation, baseline
        self.findings = evaluation.findings()
        self.state = ratchet.diff(ratchet.current(self.findings, evaluation.instances()), baseline)

    def no_new_violations(self) -> None:
        self.at_most_new(0)

    def at_most_new(self, allowed: int) -> None:
        """No project has more than so many violations that its baseline lacks."""
        new = self.state.where("state = 'new'").where(F.col("rule").isin(*gating_rules()))
        over = gating_new(self.state).where(F.col("n") > allowed).select("project", "n")
        located = ratchet.locate(new.join(over, "project"), self.evaluation.instances()).orderBy("project", "rule", "from_id", "to_id")
        _fail(f"more than {allowed} new violation(s)", located, lambda r: f"{r['project']}: {r['rule']} {r['file'] or ''}:{r['line'] or 0} {r['detail'] or r['from_id']} [{r['fp']}]")

    def coverage_at_least(self, percent: float) -> None:
        """In each project so many percent of the symbols that could be labelled are."""
        covered = classify.coverage(self.evaluation.model.symbols, self.evaluation.classified)
        low = covered.where(F.col("ratio") * 100 < percent).orderBy("project")
        _fail(f"less than {percent:g} % labelled", low, lambda r: f"{r['project']}: {r['classified']} of {r['total']}, {100 * r['ratio']:.1f} %")

    def no_unevaluable(self, exempt: tuple[str, ...] = ()) -> None:
        """Every decidable rule that is not exempt could be decided."""
        dark = self.findings.where("status = 'unevaluable' and kind = 'decidable'").where(~F.col("rule").isin(*exempt) if exempt else F.lit(True))
        _fail("rules that could not be decided", dark.orderBy("project", "no"), lambda r: f"{r['project']}: {r['rule']}: {r['because']}")


def max_components(report: DataFrame, type_name: str, most: int) -> None:
    """The type of that id or name (in a cohesion report) has at most so many components."""
    own = report.where((F.col("type") == type_name) | (F.col("type_name") == type_name))
    sized = own.select("project", "type", "type_file", "n_fields", "n_methods", "lcom4", "modularity", F.greatest(F.coalesce(F.size("components"), F.lit(0)), F.lit(1)).alias("n"))
    if sized.isEmpty():
        raise ArchitectureError(f"no type {type_name} with methods")
    _fail(f"{type_name} has more than {most} component(s)", sized.where(F.col("n") > most), lambda r: f"{r['project']}: {r['type']} in {r['type_file']}: {r['n']} components, {r['n_fields']} fields, {r['n_methods']} methods, LCOM4 {r['lcom4']}, Q {r['modularity']:.3f}")


def cohesion_flags(measured: DataFrame) -> DataFrame:
    """Types that a report draws attention to."""
    return measured.where(F.col("verdict").isin("tangled", "splittable", "disconnected"))

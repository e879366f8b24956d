"""Command line: python -m keelson scan | classify | cohesion | check | baseline | views | serve [DIR].

Exit codes: 0 fine, 1 a regression, 2 no answer.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from functools import cached_property
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import pages
from .config import load
from .operators import assertions, churn, classify, cohesion, links, ratchet, rules, views
from .plans.lineage import cut
from .serve import PORT, Workbench, serve
from .sources import crates, gitlog
from .streaming import watch

BASELINE = "architecture-baseline.json"
#: Percent of symbols without a label from which a report lists them; how much a report shows of a kind.
WORTH_SAYING, FILES_SHOWN, DIAGNOSTICS_SHOWN, INSTANCES_SHOWN, INSTANCES_OF_ALL = 10, 12, 2, 3, 100
ENTRY = "project string, fp string, rule string, from_id string, to_id string, note string"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="keelson", description="Architecture analytics of a crate.")
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in (("scan", "tables of the crate"), ("classify", "labels and gaps"), ("cohesion", "cohesion of types"), ("check", "rules against the baseline"), ("baseline", "show or renew what is accepted"), ("views", "pages of the views"), ("serve", "a local service over the crate")):
        one = sub.add_parser(name, help=text)
        one.add_argument("dir", nargs="?", default=".")
        one.add_argument("--json", action="store_true", help="rows as JSON lines")
        if name == "scan":
            one.add_argument("--out", help="folder for one JSON table each")
        if name == "baseline":
            one.add_argument("--update", action="store_true")
        if name == "classify":
            one.add_argument("--verbose", action="store_true", help="each symbol without a label")
        if name == "cohesion":
            one.add_argument("--all", action="store_true", help="cohesive types too")
        if name == "views":
            one.add_argument("name", nargs="?", help="one view only")
            one.add_argument("--out", help="folder for the pages")
            one.add_argument("--tables", action="store_true", help="tables as JSON lines instead of pages")
        if name == "serve":
            one.add_argument("--port", type=int, default=PORT)
            one.add_argument("--no-watch", action="store_true")
        if name == "check":
            one.add_argument("--all", action="store_true", help="rules that pass or cannot be decided too, and more instances")
            one.add_argument("--no-fixed", action="store_true", help="without what is fixed since the baseline")
            one.add_argument("--rule", action="append", default=[], help="gate on this rule only; repeatable")
            one.add_argument("--allow-new", type=int, default=0)
            one.add_argument("--min-coverage", type=float)
            one.add_argument("--require-evaluable", action="store_true")
    return top.parse_args(argv)


def show(df: DataFrame, as_json: bool) -> None:
    """Prints a report: a few rows for each rule or type of one crate."""
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True)) if as_json else "  ".join(str(x) for x in row))


def show_gaps(s: Session, as_json: bool, always: bool = True) -> None:
    """Files with symbols that no pattern matches, the twelve with the most; unless `always`, only
    where they are more than a tenth of all symbols."""
    covered = classify.coverage(s.model.symbols, s.labels).first()
    if always or (covered is not None and covered["ratio"] * 100 <= 100 - WORTH_SAYING):
        show(classify.gaps(s.labels).orderBy(F.desc("n"), "file").limit(FILES_SHOWN), as_json)


class Session:
    """One crate, scanned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder).resolve()
        self.project = self.folder.name
        self.config = load(self.folder / "architecture.toml")
        scan = crates.scan(crates.read_files(spark, {self.project: str(self.folder)}))
        failure = scan.failures.first()
        if failure:
            raise crates.Unscannable(failure["reason"])
        self.model = scan.model
        found = classify.classify(self.model.symbols, self.model.edges, self.model.impls, self.config)
        self.labels = found._replace(by_symbol=cut(found.by_symbol), unmatched=cut(found.unmatched))

    @cached_property
    def rules(self) -> rules.Evaluation:
        history, reason = gitlog.read(self.spark, str(self.folder / "src"), self.project)
        deps = churn.dependents(links.file_links(self.model.edges, self.model.symbols), self.model.modules)
        return rules.Evaluation(self.model, self.labels, self.config, None if reason else history, deps)

    def board(self) -> pages.Board:
        return pages.Board(self.rules, self.baseline())

    def baseline(self) -> DataFrame:
        path = self.folder / BASELINE
        kept = json.loads(path.read_text())["entries"] if path.exists() else []
        return self.spark.createDataFrame([(self.project, e["fp"], e["rule"], e["from"], e["to"], e.get("note", "")) for e in kept], ENTRY)


def check(s: Session, args: argparse.Namespace) -> int:
    evaluation = s.rules
    findings = evaluation.findings()
    state = ratchet.diff(ratchet.current(findings, evaluation.instances()), s.baseline())
    shown = findings if args.all or args.json else findings.where("status in ('violated', 'delegated')")
    show(shown.orderBy("no").select("rule", "status", "n", "because"), args.json)
    if not args.json:
        most = INSTANCES_OF_ALL if args.all else INSTANCES_SHOWN
        nth = F.row_number().over(W.partitionBy("rule").orderBy("file", "line", "from_id"))
        advised = evaluation.instances().join(findings.where("status = 'violated' and not gate").select("project", "rule"), ["project", "rule"], "left_semi")
        show(advised.withColumn("k", nth).where(F.col("k") <= most).orderBy("rule", "k").select("rule", "file", "line", "detail"), False)
        show_gaps(s, False, always=False)
    new = state.where("state = 'new'")
    if args.rule and not args.json:  # as JSON, all gating rules count
        new = new.where(F.col("rule").isin(*args.rule))
    show(ratchet.locate(new, evaluation.instances()).orderBy("rule", "from_id", "to_id").select("state", "rule", "from_id", "to_id", "file", "line"), args.json)
    if not args.no_fixed:
        show(state.where("state = 'fixed'").orderBy("rule", "from_id", "to_id").select("state", "rule", "from_id", "to_id", "note"), args.json)
    if new.count() > args.allow_new:
        return 1
    if args.require_evaluable and findings.where("status = 'unevaluable' and kind = 'decidable'").count():
        return 1
    covered = classify.coverage(s.model.symbols, s.labels).first()
    return int(args.min_coverage is not None and (covered["ratio"] if covered else 0.0) * 100 < args.min_coverage)


def baseline(s: Session, args: argparse.Namespace) -> int:
    kept = s.baseline()
    if args.update:
        evaluation = s.rules
        now = ratchet.current(evaluation.findings(), evaluation.instances())
        show(ratchet.dropped_notes(now, kept).select("rule", "from_id", "to_id", "note"), args.json)
        path = s.folder / BASELINE
        old = json.loads(path.read_text()) if path.exists() else {"progress": []}
        entries = [{"fp": r.fp, "rule": r.rule, "from": r.from_id, "to": r.to_id, "note": r.note} for r in ratchet.update(now, kept).orderBy("rule", "from_id", "to_id").toLocalIterator()]
        covered = classify.coverage(s.model.symbols, s.labels).first()
        today = {"at": datetime.now(UTC).strftime("%Y-%m-%d"), "violations": len(entries), "coverage": covered["ratio"] * 100 if covered else 0.0}
        progress = old["progress"][:-1] if old["progress"] and old["progress"][-1]["at"] == today["at"] else old["progress"]
        path.write_text(json.dumps({"entries": entries, "progress": [*progress, today]}, indent=1) + "\n")
        kept = s.baseline()
    show(kept.select("fp", "rule", "from_id", "to_id", "note"), args.json)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    gating = {r.id: r.gate for r in rules.RULES}
    for rule in getattr(args, "rule", []):
        if not gating.get(rule):
            print(f"{rule} is {'advisory and cannot gate' if rule in gating else 'no rule'}", file=sys.stderr)
            return 2
    spark = SparkSession.builder.appName("keelson").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        s = Session(spark, args.dir)
    except (crates.Unscannable, OSError, AnalysisException) as failure:
        print(failure, file=sys.stderr)
        return 2
    if args.command == "check":
        return check(s, args)
    if args.command == "baseline":
        return baseline(s, args)
    if args.command == "scan":
        if args.out:
            for name, table in s.model._asdict().items():
                table.write.mode("overwrite").json(f"{args.out}/{name}")
        show(links.stats(s.model.symbols, s.model.modules, s.model.edges), args.json)
        show(links.extern_rollup(s.model.edges).orderBy(F.desc("refs"), "key").limit(FILES_SHOWN).select("key", "refs"), args.json)
        nth = F.row_number().over(W.partitionBy("kind").orderBy("file", "line"))
        show(s.model.diagnostics.withColumn("k", nth).where(F.col("k") <= DIAGNOSTICS_SHOWN).orderBy("kind", "k").select("kind", "file", "line", "detail"), args.json)
        if not args.json:
            show_gaps(s, False, always=False)
    elif args.command == "classify":
        show(classify.coverage(s.model.symbols, s.labels), args.json)
        if args.verbose:
            show(s.labels.unmatched.orderBy("file", "line", "ord").select("file", "line", "kind", "name"), args.json)
        else:
            show_gaps(s, args.json)
    elif args.command == "views":
        out = args.out or str(s.folder / ".keelson" / "views")
        if args.name and args.name not in pages.VIEWS:
            print(f"no view {args.name}", file=sys.stderr)
            return 2
        if args.tables:
            s.board().write(out, (args.name,) if args.name else ())
        else:
            print("\n".join(pages.write_pages(s.board(), s.project, Path(out), args.name)))
    elif args.command == "serve":
        serving(spark, args)
    else:
        report = cohesion.report(s.model)
        report = report if args.all or args.json else assertions.cohesion_flags(report)
        show(report.select("type", "n_fields", "n_methods", "lcom4", "lcom4_core", "modularity", "verdict"), args.json)
    return 0


def serving(spark: SparkSession, args: argparse.Namespace) -> None:
    """Serves the crate until it is interrupted."""

    def scan() -> tuple[dict, dict[str, str]]:
        s = Session(spark, args.dir)
        board = s.board()
        tables = board.tables("workbench")
        payload = {"project": s.project, "tiers": [{"id": i, "title": t} for i, t in views.tiers(s.config)]} | {name: pages._rows(table, s.project) for name, table in tables.items()}
        return payload, {r["path"]: r["text"] for r in s.model.texts.collect()}

    def mark() -> object:
        found = watch.listing_fingerprint(watch.listing(spark, args.dir, "served")).first()
        return found["fingerprint"] if found else None

    server = serve(Workbench(scan, None if args.no_watch else mark), args.port)
    print(f"http://localhost:{server.server_address[1]}/", flush=True)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.server_close()


if __name__ == "__main__":
    sys.exit(main())

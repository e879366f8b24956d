"""The views as tables for sinks, and as pages that hold one project's tables as JSON."""

from __future__ import annotations

import html
import json
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import title_case
from .operators import assertions, churn, classify, cohesion, links, ratchet, rules, views, wiring
from .plans.lineage import cut

#: Views in the order of the index, and what each is about.
VIEWS = {
    "atlas": "modules, their links and the ports between them",
    "city": "modules as towers, a floor for each type",
    "layers": "symbols on the planes of their layers",
    "traffic": "what is reached from each entry",
    "hotspots": "files that change often and carry much",
    "cohesion": "which methods of a type belong together",
    "workbench": "parts, what they need and what they offer",
}

_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:15px/1.5 sans-serif;margin:2em auto;max-width:72em}}table{{border-collapse:collapse;margin:1em 0}}td,th{{border:1px solid #ccc;padding:.2em .5em;text-align:left;vertical-align:top}}</style>
</head><body><h1>{title}</h1><p>{about}</p>{body}
<script type="application/json" id="data">{data}</script>
<script>
const data = JSON.parse(document.getElementById('data').textContent);
for (const [name, rows] of Object.entries(data)) {{
  const head = document.createElement('h2'); head.textContent = name + ' (' + rows.length + ')'; document.body.append(head);
  const table = document.createElement('table'); document.body.append(table);
  const line = (cells, tag) => {{ const tr = table.insertRow(); for (const c of cells) {{ const e = document.createElement(tag); e.textContent = typeof c === 'object' && c !== null ? JSON.stringify(c) : c ?? ''; tr.append(e); }} }};
  if (rows.length) {{ const keys = [...new Set(rows.flatMap(r => Object.keys(r)))]; line(keys, 'th'); for (const r of rows) line(keys.map(k => r[k]), 'td'); }}
}}
</script></body></html>
"""


def script_safe(text: str) -> str:
    """JSON that may stand inside a script element and is still the same JSON."""
    return text.replace("</", "<\\u002F").replace("<!", "<\\u0021")


class Board:
    """All views of an evaluated model, each a few tables with a project column."""

    def __init__(self, evaluation: rules.Evaluation, baseline: DataFrame):
        self.evaluation, self.baseline = evaluation, baseline
        self.model, self.classified, self.config = evaluation.model, evaluation.classified, evaluation.config

    @cached_property
    def findings(self) -> DataFrame:
        return self.evaluation.findings()

    @cached_property
    def state(self) -> DataFrame:
        return ratchet.diff(ratchet.current(self.findings, self.evaluation.instances()), self.baseline)

    @cached_property
    def entries(self) -> DataFrame:
        return views.entries(self.model, self.classified)

    @cached_property
    def hops(self) -> DataFrame:
        return cut(views.traffic(self.model, self.classified))

    @cached_property
    def cohesion(self) -> DataFrame:
        return cohesion.report(self.model)

    @cached_property
    def module_links(self) -> DataFrame:
        return links.file_links(self.model.edges, self.model.symbols)

    def _atlas(self) -> dict[str, DataFrame]:
        return {
            "nodes": views.atlas_nodes(self.model, self.classified, self.config), "links": self.module_links, "ports": views.atlas_ports(self.model, self.classified),
            "shape": views.atlas_shape(self.classified), "sides": views.atlas_sides(self.model, self.classified), "findings": self.findings.where("status = 'violated'"),
        }

    def _city(self) -> dict[str, DataFrame]:
        floors = views.city_floors(self.model, self.classified, self.config)
        broken = self.findings.where("status = 'violated'").select("project", "rule")
        return {
            "floors": floors, "towers": views.city_towers(floors, self.config), "entries": views.city_entries(self.entries, self.model.symbols),
            "findings": views.city_findings(self.evaluation.instances().join(broken, ["project", "rule"], "left_semi"), self.model.symbols),
        }

    def _layers(self) -> dict[str, DataFrame]:
        return {"nodes": views.layer_nodes(self.model, self.classified, self.config), "links": views.layer_links(self.model, self.classified, self.config, self.evaluation.instances())}

    def _traffic(self) -> dict[str, DataFrame]:
        return {"entries": self.entries, "hops": self.hops, "untraced": views.untraced(self.entries, self.hops), "subsets": views.traffic_subsets(self.hops, self.config)}

    def _hotspots(self) -> dict[str, DataFrame]:
        history = self.evaluation.commit_files
        if history is None:
            return {}
        files = churn.scored(churn.per_file(history), churn.dependents(self.module_links, self.model.modules))
        return {"nodes": views.hotspot_nodes(self.model, self.classified, self.config, files), "links": views.hotspot_links(self.module_links, self.model.modules), "meta": views.hotspot_meta(history), "hot": churn.hotspots(files)}

    def _cohesion(self) -> dict[str, DataFrame]:
        touches = cohesion.members(self.model.symbols)
        flagged = assertions.cohesion_flags(self.cohesion)
        touched, groups = cohesion.field_links(touches), cohesion.memberships(flagged)
        own = touched.join(flagged.select(*cohesion.TYPE_KEYS), cohesion.TYPE_KEYS, "left_semi")
        idle = cohesion.unused_and_write_only(touches, self.model.foreign_field_reads)
        return {"types": flagged, "cells": views.matrix_cells(own, groups, cohesion.TYPE_KEYS), "idle": idle, "mixed": cohesion.mixed_concern(self.model.symbols, self.model.edges)}

    def _workbench(self) -> dict[str, DataFrame]:
        w = wiring.Wiring(self.model, self.classified, self.config, self.entries.select("project", "id", "verb"))
        out = {"bricks": w.bricks, "wires": w.wires, "calls": w.calls, "implementors": w.implementors, "sockets": w.sockets, "studs": w.studs, "meta": w.meta, "endpoints": views.endpoints(self.entries, self.model.symbols)}
        return out if self.model.diagnostics is None else out | {"diagnostics": self.model.diagnostics}

    def tables(self, view: str) -> dict[str, DataFrame]:
        """The tables of one view."""
        return getattr(self, f"_{view}")()

    @cached_property
    def narration(self) -> DataFrame:
        covered = classify.coverage(self.model.symbols, self.classified)
        return views.narration_slots(self.findings, covered, self.model.impls, ratchet.enforcement(self.findings), self.state, assertions.cohesion_flags(self.cohesion))

    def available(self) -> DataFrame:
        """project, view: the views that have something to say about a project."""
        every = self.model.modules.select("project").distinct()
        always = every.select("project", F.explode(F.array(*[F.lit(v) for v in VIEWS if v not in ("cohesion", "traffic", "hotspots")])).alias("view"))
        out = always.unionByName(assertions.cohesion_flags(self.cohesion).select("project", F.lit("cohesion").alias("view")).distinct())
        out = out.unionByName(self.entries.select("project", F.lit("traffic").alias("view")).distinct())
        if self.evaluation.commit_files is not None:
            out = out.unionByName(churn.availability(self.evaluation.commit_files).where("available").select("project", F.lit("hotspots").alias("view")))
        return out

    def index(self) -> DataFrame:
        """project, title, view, about: a line for each view of a project."""
        about = F.element_at(F.create_map(*[F.lit(x) for pair in VIEWS.items() for x in pair]), F.col("view"))
        return self.available().select("project", title_case(F.col("project")).alias("title"), "view", about.alias("about"))

    def write(self, out: str, only: tuple[str, ...] = ()) -> None:
        """Every table of the views (or of those named) as JSON lines in out/view/table, by project;
        with them out/index and out/narration. Nothing passes through the driver."""
        sink = lambda df, name: df.write.mode("overwrite").partitionBy("project").json(f"{out}/{name}")
        shown = self.available()
        for view in only or VIEWS:
            has = shown.where(F.col("view") == view).select("project")
            for name, table in self.tables(view).items():
                sink(table.join(has, "project", "left_semi"), f"{view}/{name}")
        if not only:
            sink(self.index(), "index")
            sink(self.narration, "narration")


def _rows(table: DataFrame, project: str) -> list[dict]:
    return [json.loads(r) for r in table.where(F.col("project") == project).drop("project").toJSON().toLocalIterator()]


def page(board: Board, view: str, project: str) -> str:
    """One view of one project as a page."""
    if view not in VIEWS:
        raise ValueError(f"no view {view}")
    data = {name: _rows(table, project) for name, table in board.tables(view).items()}
    return _PAGE.format(title=html.escape(f"{project}: {view}"), about=html.escape(VIEWS[view]), body="", data=script_safe(json.dumps(data)))


def write_pages(board: Board, project: str, out: Path, only: str | None = None) -> list[str]:
    """Pages of the available views of one project, and their index, in the folder out."""
    out.mkdir(parents=True, exist_ok=True)
    there = {r["view"] for r in board.available().where(F.col("project") == project).collect()}
    if only is not None and only not in VIEWS:
        raise ValueError(f"no view {only}")
    written = [v for v in VIEWS if (v == only if only else v in there)]
    for view in written:
        (out / f"{view}.html").write_text(page(board, view, project))
    if only is None:
        said = "".join(f"<p>{html.escape(r['text'])}</p>" for r in _rows(board.narration, project))
        cards = "".join(f'<p><a href="{v}.html">{v}</a>: {html.escape(VIEWS[v])}</p>' for v in written)
        (out / "index.html").write_text(_PAGE.format(title=html.escape(project), about="", body=said + cards, data="{}"))
    return written

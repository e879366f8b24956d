"""Assertions, pages, the service, snapshots and the command line, on one small crate."""

from __future__ import annotations

import http.client
import json
import threading
import time

import pytest
from crates import SHOP
from pyspark.sql import functions as F

from keelson import __main__ as cli
from keelson import functions as fn
from keelson import pages, serve
from keelson.config import PROFILE
from keelson.operators import assertions, classify, cohesion, ratchet, rules, views
from keelson.plans.lineage import cut
from keelson.sources import crates
from keelson.sources.snapshots import BASELINE, Snapshots


@pytest.fixture(scope="module")
def evaluation(spark):
    rows = [("shop", path, text) for path, text in SHOP.items()]
    model = crates.scan(spark.createDataFrame(rows, "project string, path string, text string")).model
    labels = classify.classify(model.symbols, model.edges, model.impls, PROFILE)
    return rules.Evaluation(model, labels._replace(by_symbol=cut(labels.by_symbol)), PROFILE)


def test_assertions(spark, evaluation):
    none = spark.createDataFrame([], BASELINE)
    checks = assertions.Checks(evaluation, none)
    n = checks.state.count()
    assert n > 0
    with pytest.raises(assertions.ArchitectureError, match="shop: "):
        checks.no_new_violations()
    checks.at_most_new(n)
    with pytest.raises(assertions.ArchitectureError):
        checks.at_most_new(n - 1)
    accepted = ratchet.update(ratchet.current(checks.findings, evaluation.instances()), none)
    assertions.Checks(evaluation, cut(accepted)).no_new_violations()
    checks.coverage_at_least(10)
    with pytest.raises(assertions.ArchitectureError, match="of"):
        checks.coverage_at_least(100.5)
    with pytest.raises(assertions.ArchitectureError, match="churn-concentration"):
        checks.no_unevaluable()
    dark = [r.rule for r in checks.findings.where("status = 'unevaluable'").collect()]
    checks.no_unevaluable(tuple(dark))
    assert assertions.gating_new(checks.state).first().n == n and assertions.gating_new(checks.state, ("no-such",)).first().n == 0
    report = cut(cohesion.report(evaluation.model))
    assertions.max_components(report, "Item", 2)
    with pytest.raises(assertions.ArchitectureError, match="no type"):
        assertions.max_components(report, "Nothing", 1)
    assert {r.verdict for r in assertions.cohesion_flags(report).collect()} <= {"tangled", "splittable", "disconnected"}


def test_pages_and_tables(spark, evaluation, tmp_path):
    board = pages.Board(evaluation, spark.createDataFrame([], BASELINE))
    shown = {r.view for r in board.available().collect()}
    assert {"atlas", "city", "layers", "workbench", "traffic"} <= shown and "hotspots" not in shown
    written = pages.write_pages(board, "shop", tmp_path / "pages")
    assert set(written) == shown and (tmp_path / "pages/index.html").exists()
    text = (tmp_path / "pages/atlas.html").read_text()
    data = json.loads(text.split('id="data">')[1].split("</script>")[0])
    assert {n["module"] for n in data["nodes"]} >= {"domain", "infra"} and any(s["side"] == "platform" and s["module"] == "infra" for s in data["sides"])
    with pytest.raises(ValueError):
        pages.page(board, "nothing", "shop")
    board.write(str(tmp_path / "tables"), ("atlas", "cohesion"))
    rows = spark.read.json(str(tmp_path / "tables/atlas/nodes"))
    assert {r.project for r in rows.select("project").collect()} == {"shop"}
    slots = {r.slot: r.text for r in board.narration.collect()}
    assert {"coverage", "ports", "enforcement", "baseline", "unevaluable"} <= set(slots) and "0 known" in slots["baseline"]


def test_script_safe():
    text = json.dumps({"a": "</script><!-- x"})
    assert "</" not in pages.script_safe(text) and "<!" not in pages.script_safe(text) and json.loads(pages.script_safe(text)) == json.loads(text)


def test_traffic_filters(spark, evaluation):
    start = views.entries(evaluation.model, evaluation.classified)
    names = lambda df: {r.id for r in df.collect()}
    assert names(views.traffic_filter(start, evaluation.model.symbols)) == names(start)
    assert names(views.traffic_filter(start, evaluation.model.symbols, query="RUN_ADD")) == {"application::run_add"}
    assert not names(views.traffic_filter(start, evaluation.model.symbols, verbs=()))


def test_snapshots(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "s"))
    assert kept.read().count() == 0
    row = lambda note: spark.createDataFrame([("p", "f", "r", "a", "b", note)], BASELINE)
    kept.write(row("one"))
    kept.write(kept.read().withColumn("note", F.lit("two")))  # computed from the one it replaces
    assert [r.note for r in kept.read().collect()] == ["two"]
    kept.prune()
    assert [r.note for r in kept.read().collect()] == ["two"] and len(list((tmp_path / "s").glob("v-*"))) == 1


@pytest.mark.parametrize("query,want", [("file=a%2Fb+c", "a/b c"), ("x=1&file=%E6%BC%A2", "漢"), ("file=%zz%4", "%zz%4"), ("file=", ""), ("file", None), ("", None)])
def test_parameters(spark, query, want):
    assert serve.parameter(query, "file") == want
    if want and "=" in query:
        raw = query.split("file=")[1]
        assert spark.range(1).select(fn.percent_decoded(F.lit(raw))).first()[0] == want


def test_service():
    state = {"texts": {"lib.rs": "fn a() {}"}, "mark": 1}

    def scan():
        if state["texts"] is None:
            raise ValueError("broken\nsecond line")
        return {"project": "p", "files": sorted(state["texts"])}, dict(state["texts"])

    bench = serve.Workbench(scan, lambda: state["mark"], poll=0.02)
    server = serve.serve(bench, 0)
    port = server.server_address[1]
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, method="GET", host=f"localhost:{port}", **headers):
        c = http.client.HTTPConnection("127.0.0.1", port, timeout=5)
        c.request(method, path, headers={"Host": host, **headers})
        r = c.getresponse()
        return r.status, r.read()

    try:
        status, body = ask("/api/model")
        assert status == 200 and json.loads(body) == {"project": "p", "files": ["lib.rs"], "version": 1, "error": None, "watching": True, "changes": False}
        assert ask("/api/source?file=lib.rs") == (200, b"fn a() {}") and ask("/api/source?file=no.rs")[0] == 404
        assert ask("/")[0] == 200 and ask("/favicon.ico")[0] == 204 and ask("/api/change")[0] == 501 and ask("/nothing")[0] == 404
        assert ask("/", host="evil.example")[0] == 403 and ask("/", method="POST")[0] == 405 and ask("/", big="x" * 20_000)[0] == 431
        events = http.client.HTTPConnection("127.0.0.1", port, timeout=5)
        events.request("GET", "/api/events", headers={"Host": f"localhost:{port}"})
        stream = events.getresponse()
        assert json.loads(stream.fp.readline()[6:]) == {"version": 1, "error": None}
        state.update(texts=None, mark=2)
        stream.fp.readline()
        assert json.loads(stream.fp.readline()[6:]) == {"version": 1, "error": "broken"}
        state.update(texts={"main.rs": ""}, mark=3)
        stream.fp.readline()
        assert json.loads(stream.fp.readline()[6:]) == {"version": 2, "error": None}
        assert json.loads(ask("/api/model")[1])["files"] == ["main.rs"]
    finally:
        bench.close()
        server.shutdown()
        time.sleep(0.05)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    crate = tmp_path / "shop"
    for path, text in SHOP.items():
        (crate / path).parent.mkdir(parents=True, exist_ok=True)
        (crate / path).write_text(text)
    scanned, real = cli.Session(spark, str(crate)), cli.Session
    monkeypatch.setattr(cli, "Session", lambda spark, folder: scanned if folder == str(crate) else real(spark, folder))
    run = lambda *a: cli.main([a[0], str(crate), *a[1:]])
    assert run("scan", "--json") == 0 and run("classify", "--verbose") == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["project"] == "shop"
    assert run("check") == 1 and run("check", "--allow-new", "1000", "--min-coverage", "100.5") == 1
    assert run("check", "--rule", "no-such") == 2 and run("check", "--rule", "port-has-fake") == 2
    assert run("baseline", "--update") == 0 and run("check", "--all", "--no-fixed", "--json") == 0
    capsys.readouterr()
    assert run("baseline", "--json") == 0
    assert all(json.loads(line)["rule"] for line in capsys.readouterr().out.splitlines())
    assert run("views", "atlas", "--out", str(tmp_path / "views")) == 0 and (tmp_path / "views/atlas.html").exists()
    assert run("views", "nothing") == 2 and cli.main(["check", str(tmp_path / "missing")]) == 2

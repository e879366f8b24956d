from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from crates import SHOP, TORTURE
from keelson.config import PROFILE, parse
from keelson.operators import classify, cohesion, rules, wiring
from keelson.plans.lineage import cut
from keelson.sources import crates, gitlog, manifest, rust


@pytest.fixture(scope="module")
def scan(spark):
    rows = [(name, path, text) for name, files in (("shop", SHOP), ("torture", TORTURE), ("empty", {"Cargo.toml": "[workspace]\nmembers = ['a']\n"})) for path, text in files.items()]
    return crates.scan(spark.createDataFrame(rows, "project string, path string, text string"))


def rows(df, *columns, project="shop"):
    return {tuple(r) if len(columns) > 1 else r[0] for r in df.where(F.col("project") == project).select(*columns).collect()}


def test_symbols(scan):
    found = rows(scan.model.symbols, "id", "kind", "line", "is_test")
    assert ("domain::Item", "struct", 4, False) in found  # an item starts at its doc comment
    assert ("domain::Item::label", "method", 14, False) in found
    assert ("domain::use_cases::tests::finds", "fn", 17, True) in found
    assert ("(test:flow)::flows", "fn", 3, True) in found
    assert ("application::COUNT", "static", 4, False) in found
    assert len(found) == 23


def test_modules_and_targets(scan):
    assert ("(crate)", "lib.rs") in rows(scan.model.modules, "id", "file")
    assert ("(test:flow)", "../tests/flow.rs") in rows(scan.model.modules, "id", "file")
    assert rows(scan.model.targets, "kind", "name") == {("lib", "shop_core"), ("test", "flow")}


def test_edges(scan):
    local = rows(scan.model.edges.where("to_scope = 'local'"), "from_id", "to_id", "kind", "via")
    assert ("domain::use_cases::find_item", "domain::ports::ItemStore", "bound", "store") in local
    assert ("domain::use_cases::add_item", "domain::ports::ItemStore", "bound", "store") in local
    assert ("domain::use_cases::add_item", "domain::Mode", "sig", "how") in local
    assert ("domain::use_cases::add_item", "domain::Item::fresh", "call", None) in local
    assert ("infra::SqlStore", "domain::ports::ItemStore", "impl", None) in local
    assert ("application::run_add", "domain::use_cases::add_item", "call", None) in local  # through a glob
    assert ("(test:flow)::flows", "domain::Item::fresh", "call", None) in local  # by the crate's own name
    extern = rows(scan.model.edges.where("to_scope = 'extern'"), "from_id", "to_path")
    assert ("infra::SqlStore", "rusqlite::Connection") in extern
    assert ("domain::use_cases::add_item", "std::fs::read") in extern


def test_diagnostics(scan):
    kinds = rows(scan.model.diagnostics, "kind", "detail")
    assert ("unresolved-path", "`Missing` could not be placed in infra") in kinds
    assert any(k == "glob-import" for k, _ in kinds) and any(k == "macro-item" and "macro_rules" in d for k, d in kinds)
    assert any(k == "target-skipped" and "ghost" in d for k, d in kinds) and any("example `demo`" in d for _, d in kinds)
    assert any(k == "cfg-excluded" for k, _ in kinds) is False  # the gate is on the module, not on a symbol
    assert ("missing-module", "`mod gone;` has no matching file") in rows(scan.model.diagnostics, "kind", "detail", project="torture")


def test_bodies(scan):
    by = {r["id"]: r for r in scan.model.symbols.where("project = 'shop'").collect()}
    assert [tuple(p) for p in by["domain::Item::price"].panics] == [("unwrap", 15)]
    assert by["domain::use_cases::add_item"].matches_on == ["How::Open", "How::Shut"]
    assert by["application::render_all"].field_chains == ["app.list.items.len"]
    assert by["infra::SqlStore::save"].self_fields == ["cache"]
    calls = {(c.recv, c.method, c.ty, c.callee) for c in by["(test:flow)::flows"].recv_calls}
    assert calls == {("i", "label", None, "domain::Item::fresh")}


def test_torture(scan):
    symbols = {r["id"]: r for r in scan.model.symbols.where("project = 'torture'").collect()}
    assert set(symbols) == {"RAW", "main", "helper", "Wrap", "T::fmt"}  # the first path of a self type in order
    assert symbols["helper"].sig.ret_paths == ["Box", "Fn", "Result", "T", "fmt::Error", "u8"]
    assert symbols["helper"].sig.generics[0].bounds == ["Clone", "Display"]
    assert [f.name for f in symbols["Wrap"].fields] == ["0", "1"]


def test_failures(scan):
    assert rows(scan.failures, "reason", project="empty") == {"a workspace root without a package of its own"}


def test_unreadable():
    for text in ("fn {", "fn f() { (] }", "/* open", 'let s = "open'):
        with pytest.raises(rust.Unreadable):
            rust.lex(text)


def test_rules_and_wiring(scan):
    model = scan.model
    labels = classify.classify(model.symbols, model.edges, model.impls, PROFILE)
    found = dict(rows(labels.by_symbol, "id", "pattern"))
    assert found["domain::ports::ItemStore"] == "port" and found["domain::use_cases::add_item"] == "use-case" and found["infra::SqlStore"] == "store"
    evaluation = rules.Evaluation(model, labels, PROFILE)
    hits = rows(evaluation.instances(), "rule", "from_id")
    assert ("domain-no-io", "domain::use_cases::add_item") in hits
    assert ("panic-in-domain", "domain::Item::price") in hits and ("no-global-mut", "application::COUNT") in hits
    assert ("call-through-port", "application::run_add") in hits and ("concrete-outside-root", "application") in hits
    assert ("renders-off-store", "application::render_all") in hits
    status = {r["rule"]: r["status"] for r in evaluation.findings().where("project = 'shop'").collect()}
    assert status["dependency-inversion"] == "upheld" and status["churn-concentration"] == "unevaluable" and status["untested-port"] == "pass" and len(status) == 24
    w = wiring.Wiring(model, labels, PROFILE)
    assert ("infra::SqlStore", "external", "rusqlite::Connection", "conn") in rows(w.sockets, "brick", "status", "external", "prop")
    assert ("infra::Pool", "unresolved", "slot") in rows(w.sockets, "brick", "status", "prop")
    assert ("domain::ports::ItemStore", "infra::SqlStore") in rows(w.implementors, "trait_id", "bound_to")
    assert ("domain::use_cases::*", "domain::ports::ItemStore", "param") in rows(w.calls, "brick", "to", "via")
    types = {r["type"]: r for r in cohesion.report(model).where("project = 'shop'").collect()}
    assert types["domain::Item"].lcom4 == 2 and types["domain::Item"].verdict == "cohesive"


def test_manifest_and_config():
    m = manifest.parse('[package]\nname = "a-b"\n[dependencies]\nx-y = "1"\n[[test]]\nname = "t"\npath = "q.rs"\n[workspace]\nmembers = ["m"]\n')
    assert m.externs == ("x_y",) and m.tests == (("t", "q.rs"),) and m.members == ("m",)
    c = parse('extends = "profile"\n[[add_pattern]]\nid = "first"\nlayer = "domain"\n')
    assert c.patterns[0].id == "first" and c.patterns[1].id == "port" and c.flow == PROFILE.flow


def test_git_log(spark, tmp_path):
    text = "\x02h2\x01ann\x012024-01-02\n\n3\t1\tsub/a.rs\n-\t-\tsub/b.png\n\x02h1\x01bob\x012024-01-01\n\n5\t0\tsub/a.rs\n1\t1\tother.rs\n"
    (tmp_path / "log").write_text(text)
    for commits in (gitlog.records(spark.createDataFrame([("p", text)], "project string, text string")), gitlog.read_records(spark, str(tmp_path / "log"), "p")):
        found = gitlog.parse(commits, "sub/").orderBy("ord").collect()
        assert [(r.hash, r.author, r.path, r.added, r.removed) for r in found] == [("h2", "ann", "a.rs", 3, 1), ("h2", "ann", "b.png", 0, 0), ("h1", "bob", "a.rs", 5, 0)]
    assert gitlog.read(spark, "/proc", "p")[1].startswith("git")
    own = tmp_path / "repo"
    own.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(own), "-c", "user.name=a b", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(2):
        (own / "x.rs").write_text("line\n" * (k + 1))
        run("add", "."), run("commit", "-qm", f"c{k}")
    history, reason = gitlog.read(spark, str(own), "p")
    assert not reason and sorted((r.path, r.author, r.added) for r in history.collect()) == [("x.rs", "a b", 1), ("x.rs", "a b", 1)]


def test_folder_on_disk(spark, tmp_path):
    for path, text in SHOP.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "target").mkdir()
    (tmp_path / "target/x.rs").write_text("fn {")
    found = crates.scan(cut(crates.read_files(spark, {"shop": str(tmp_path)})))
    assert found.model.symbols.count() == 23
    assert crates.source_of(found.model, "shop", "lib.rs").startswith("pub mod domain") and crates.source_of(found.model, "shop", "no.rs") is None

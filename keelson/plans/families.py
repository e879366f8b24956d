"""A small crate for each family of parts, and what a scan of it must find, written out by hand.

The texts and the expectations are templates over the names of a family's parts; Spark fills in
the texts, DuckDB the expectations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import crates
from .adapters import FAMILY, Trade

#: Names in templates, and the place in the family of the part that has the name.
NAMES = {"E": 0, "S": 1, "get": 2, "swap": 3, "into": 4, "make": 5, "T": 6, "show": 7, "turn": 8, "first": 9, "second": 10, "third": 11}

FILES = {
    "Cargo.toml": '[package]\nname = "fam-{blk}"\n[dependencies]\nserde = "1"\n[[bin]]\nname = "ghost"\n',
    "src/lib.rs": "pub mod shapes;\nmod work;\nmod near;\npub mod gone;\n",
    "src/near.rs": "use super::shapes::*;\npub fn near(x: {E}) -> {E} { {S}::{make}(); x }\n",
    "src/shapes.rs": (
        "use std::fmt;\n"
        "pub enum {E} { First, Second(u8) }\n"
        "#[derive(Clone, Debug)]\n"
        "pub struct {S} { pub a: u32, b: {E}, pub gone: Missing }\n"
        "impl {S} {\n"
        "    pub fn {get}(&self) -> u32 { self.a }\n"
        "    fn {swap}(&mut self, x: {E}) -> {E} { self.{get}(); self.b = x; match self.a { _ => {E}::First } }\n"
        "    pub async fn {into}(self) -> Self { self }\n"
        "    pub fn {make}() -> {S} { {S} { a: 1, b: {E}::First, gone: todo() } }\n"
        "}\n"
        "pub trait {T} { fn {show}(&self); fn {turn}(&self, e: {E}) -> {E}; }\n"
        "impl {T} for {S} { fn {show}(&self) { self.b.x.unwrap(); } fn {turn}(&self, e: {E}) -> {E} { e } }\n"
    ),
    "src/work.rs": (
        "use crate::shapes::{{S}, {E}, {T}};\n"
        "use serde::Serialize as Ser;\n"
        "pub fn {first}(x: &{S}) -> {E} { x.{turn}({E}::First) }\n"
        "pub fn {second}(p: &impl {T}) { p.{show}(); }\n"
        '#[cfg(feature = "extra")]\n'
        'pub fn {third}(app: &Ser) { let s = {S}::{make}(); s.{get}(); std::fs::read("x"); app.a.b.c; }\n'
        "static mut COUNT: u32 = 0;\n"
    ),
    "tests/flow.rs": "use fam_{blk}::work::{first};\n#[test]\nfn flows() { {first}(&fam_{blk}::shapes::{S}::{make}()); }\n",
}

#: What each table of the scan must hold, as rows of templates.
EXPECTED: dict[str, tuple[tuple[str, ...], list[tuple]]] = {
    "targets": (("kind", "name", "file"), [("lib", "fam_{blk}", "lib.rs"), ("test", "flow", "../tests/flow.rs")]),
    "modules": (("id", "file", "parent", "loc"), [("(crate)", "lib.rs", None, 4), ("shapes", "shapes.rs", None, 12), ("work", "work.rs", None, 7), ("near", "near.rs", None, 2), ("(test:flow)", "../tests/flow.rs", None, 3)]),
    "symbols": (
        ("id", "kind", "name", "module", "parent", "file", "line", "vis", "is_test"),
        [
            ("shapes::{E}", "enum", "{E}", "shapes", None, "shapes.rs", 2, "public", False),
            ("shapes::{S}", "struct", "{S}", "shapes", None, "shapes.rs", 3, "public", False),
            ("shapes::{S}::{get}", "method", "{get}", "shapes", "shapes::{S}", "shapes.rs", 6, "public", False),
            ("shapes::{S}::{swap}", "method", "{swap}", "shapes", "shapes::{S}", "shapes.rs", 7, "private", False),
            ("shapes::{S}::{into}", "method", "{into}", "shapes", "shapes::{S}", "shapes.rs", 8, "public", False),
            ("shapes::{S}::{make}", "method", "{make}", "shapes", "shapes::{S}", "shapes.rs", 9, "public", False),
            ("shapes::{T}", "trait", "{T}", "shapes", None, "shapes.rs", 11, "public", False),
            ("shapes::{T}::{show}", "method", "{show}", "shapes", "shapes::{T}", "shapes.rs", 11, "public", False),
            ("shapes::{T}::{turn}", "method", "{turn}", "shapes", "shapes::{T}", "shapes.rs", 11, "public", False),
            ("shapes::{S}::{show}", "method", "{show}", "shapes", "shapes::{S}", "shapes.rs", 12, "private", False),
            ("shapes::{S}::{turn}", "method", "{turn}", "shapes", "shapes::{S}", "shapes.rs", 12, "private", False),
            ("near::near", "fn", "near", "near", None, "near.rs", 2, "public", False),
            ("work::{first}", "fn", "{first}", "work", None, "work.rs", 3, "public", False),
            ("work::{second}", "fn", "{second}", "work", None, "work.rs", 4, "public", False),
            ("work::{third}", "fn", "{third}", "work", None, "work.rs", 5, "public", False),
            ("work::COUNT", "static", "COUNT", "work", None, "work.rs", 7, "private", False),
            ("(test:flow)::flows", "fn", "flows", "(test:flow)", None, "../tests/flow.rs", 2, "private", True),
        ],
    ),
    "details": (
        ("id", "derives", "fields", "self_fields", "self_reads", "self_calls", "chains", "cfg", "signature"),
        [
            ("shapes::{E}", "", "Second::0: u8", "", "", "", "", "", None),
            ("shapes::{S}", "Clone,Debug", "a: u32,b: {E},gone: Missing", "", "", "", "", "", None),
            ("shapes::{S}::{get}", "", "", "a", "a", "", "", "", "(&self) -> u32"),
            ("shapes::{S}::{swap}", "", "", "a,b", "a", "{get}", "", "", "(&mut self, x: {E}) -> {E}"),
            ("shapes::{S}::{into}", "", "", "", "", "", "", "", "async (self) -> Self"),
            ("shapes::{S}::{make}", "", "", "", "", "", "", "", "() -> {S}"),
            ("shapes::{T}", "", "", "", "", "", "", "", None),
            ("shapes::{T}::{show}", "", "", "", "", "", "", "", "(&self)"),
            ("shapes::{T}::{turn}", "", "", "", "", "", "", "", "(&self, e: {E}) -> {E}"),
            ("shapes::{S}::{show}", "", "", "b", "b", "", "self.b.x", "", "(&self)"),
            ("shapes::{S}::{turn}", "", "", "", "", "", "", "", "(&self, e: {E}) -> {E}"),
            ("work::{first}", "", "", "", "", "", "", "", "(x: &{S}) -> {E}"),
            ("work::{second}", "", "", "", "", "", "", "", "(p: &impl {T})"),
            ("near::near", "", "", "", "", "", "", "", "(x: {E}) -> {E}"),
            ("work::{third}", "", "", "", "", "", "app.a.b.c", 'cfg (feature = "extra")', "(app: &Ser)"),
            ("work::COUNT", "", "COUNT: mut u32", "", "", "", "", "", None),
            ("(test:flow)::flows", "", "", "", "", "", "", "", "()"),
        ],
    ),
    "edges": (
        ("from_id", "to_id", "kind", "via"),
        [
            ("shapes::{S}", "shapes::{E}", "field", "b"),
            ("shapes::{S}::{swap}", "shapes::{E}", "sig", "x"), ("shapes::{S}::{swap}", "shapes::{E}", "sig", "->"),
            ("shapes::{S}::{make}", "shapes::{S}", "sig", "->"),
            ("shapes::{T}::{turn}", "shapes::{E}", "sig", "e"), ("shapes::{T}::{turn}", "shapes::{E}", "sig", "->"),
            ("shapes::{S}", "shapes::{T}", "impl", None),
            ("shapes::{S}::{turn}", "shapes::{E}", "sig", "e"), ("shapes::{S}::{turn}", "shapes::{E}", "sig", "->"),
            ("work", "shapes::{S}", "use", None), ("work", "shapes::{E}", "use", None), ("work", "shapes::{T}", "use", None),
            ("near::near", "shapes::{E}", "sig", "x"), ("near::near", "shapes::{E}", "sig", "->"), ("near::near", "shapes::{S}::{make}", "call", None),
            ("work::{first}", "shapes::{S}", "sig", "x"), ("work::{first}", "shapes::{E}", "sig", "->"),
            ("work::{second}", "shapes::{T}", "bound", "p"),
            ("work::{third}", "shapes::{S}::{make}", "call", None),
            ("(test:flow)", "work::{first}", "use", None),
            ("(test:flow)::flows", "work::{first}", "call", None), ("(test:flow)::flows", "shapes::{S}::{make}", "call", None),
        ],
    ),
    "externs": (("from_id", "to_krate", "to_path", "kind"), [("shapes", "std", "std::fmt", "use"), ("work", "serde", "serde::Serialize", "use"), ("work::{third}", "serde", "serde::Serialize", "sig"), ("work::{third}", "std", "std::fs::read", "call")]),
    "impls": (("trait_id", "type_id", "file", "line", "methods", "is_test"), [("shapes::{T}", "shapes::{S}", "shapes.rs", 12, "{show},{turn}", False)]),
    "receivers": (("id", "recv", "method", "ty", "callee"), [("work::{first}", "x", "{turn}", None, None), ("work::{second}", "p", "{show}", None, None), ("work::{third}", "s", "{get}", None, "shapes::{S}::{make}")]),
    "panics": (("id", "method", "line"), [("shapes::{S}::{show}", "unwrap", 12)]),
    "diagnostics": (
        ("kind", "file", "line", "about"),
        [
            ("target-skipped", "Cargo.toml", 0, "bin `ghost`"), ("missing-module", "lib.rs", 4, "`mod gone;`"), ("glob-import", "near.rs", 1, "`use super::shapes::*`"),
            ("unresolved-path", "shapes.rs", 3, "`Missing`"), ("cfg-excluded", "work.rs", 5, 'cfg (feature = "extra")'),
        ],
    ),
}


def _filled(template: str) -> Column:
    out = F.lit(template)
    for name in [*NAMES, "blk"]:
        if f"{{{name}}}" in template:
            out = F.replace(out, F.lit(f"{{{name}}}"), F.col(f"_{name}"))
    return out


def files(t: Trade) -> DataFrame:
    """project, path, text: the crates of all families."""
    at = lambda k: F.max(F.when(F.col("n") % FAMILY == k, F.col("name")))
    named = t.parts.groupBy(F.floor(F.col("n") / FAMILY).cast("string").alias("_blk")).agg(*[at(k).alias(f"_{name}") for name, k in NAMES.items()])
    texts = F.array(*[F.struct(F.lit(path).alias("path"), _filled(text).alias("text")) for path, text in FILES.items()])
    return named.select(F.concat(F.lit("fam-"), "_blk").alias("project"), F.explode(texts).alias("f")).select("project", "f.path", "f.text")


def found(scan: crates.Scan, table: str) -> DataFrame:
    """The columns of EXPECTED of one table of a scan."""
    m, join = scan.model, lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    if table == "details":
        param = F.transform("sig.params", lambda p: F.concat(p["name"], F.lit(": "), p["ty"]))
        args = F.array_join(F.concat(F.array_compact(F.array("sig.receiver")), param), ", ")
        written = F.concat(F.when(F.col("sig.is_async"), "async ").otherwise(""), F.lit("("), args, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "sig.ret"), F.lit("")))
        shown = F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(": "), f["ty"])), ",")
        return m.symbols.select("project", "id", join("derives"), shown.alias("fields"), join("self_fields"), join("self_reads"), join("self_calls"), F.array_join("field_chains", ",").alias("chains"), F.array_join("cfg", ",").alias("cfg"), F.when(F.col("sig").isNotNull(), written).alias("signature"))
    if table == "receivers":
        return m.symbols.select("project", "id", F.explode("recv_calls").alias("c")).select("project", "id", "c.recv", "c.method", "c.ty", "c.callee")
    if table == "panics":
        return m.symbols.select("project", "id", F.explode("panics").alias("p")).select("project", "id", "p.method", "p.line")
    if table == "diagnostics":
        about = F.when(F.col("kind") == "cfg-excluded", F.split_part("detail", F.lit("`"), F.lit(2))).when(F.col("kind") == "target-skipped", F.concat(F.lit("bin `"), F.split_part("detail", F.lit("`"), F.lit(2)), F.lit("`")))
        about = F.coalesce(about, F.concat(F.lit("`"), F.split_part("detail", F.lit("`"), F.lit(2)), F.lit("`")))
        return m.diagnostics.select("project", "kind", "file", "line", about.alias("about"))
    rows = {"targets": m.targets, "modules": m.modules, "symbols": m.symbols, "edges": m.edges.where("to_scope = 'local'"), "externs": m.edges.where("to_scope = 'extern'"), "impls": m.impls}[table]
    rows = rows.withColumn("methods", F.array_join("methods", ",")) if table == "impls" else rows
    out = rows.select("project", *EXPECTED[table][0])
    return out.distinct() if table in ("edges", "externs") else out


def expected_sql(table: str) -> str:
    """EXPECTED of one table for all families, behind the expression `plain`."""
    columns, rows = EXPECTED[table]

    def cell(x) -> str:
        if x is None:
            return "NULL"
        return str(x) if isinstance(x, bool | int) else "'" + x.replace("'", "''") + "'"

    names = ", ".join(f"max(name) FILTER (k = {k}) AS n_{name}" for name, k in NAMES.items())
    fill = lambda c: f"replace({_nested(c)}, '{{blk}}', blk::VARCHAR)"

    def _nested(c: str) -> str:
        for name in NAMES:
            c = f"replace({c}, '{{{name}}}', n_{name})"
        return c

    texts = {i for i in range(len(columns)) if any(isinstance(r[i], str) for r in rows)}
    shown = ", ".join(f"{fill(f'c{i}')} AS \"{c}\"" if i in texts else f'c{i} AS "{c}"' for i, c in enumerate(columns))
    values = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT 'fam-' || blk AS family, {shown} FROM (SELECT blk, {names} FROM plain GROUP BY blk), (VALUES {values}) v({', '.join(f'c{i}' for i in range(len(columns)))})"

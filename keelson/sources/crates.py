"""Crates as logical tables: files are parsed in parallel by project, names are resolved by joins."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import resolve
from ..plans.lineage import cut
from ..schema import Model
from . import manifest, rust
from .rust import joined


class Unscannable(Exception):
    """There is no crate here."""


class _Project:
    """One crate: `files` maps paths relative to the crate's folder to texts."""

    def __init__(self, project: str, files: dict[str, str]):
        self.project, self.files = project, files
        self.manifest = manifest.parse(files["Cargo.toml"]) if "Cargo.toml" in files else manifest.Manifest(project)
        self.rows: list[tuple[str, dict]] = []
        self.tainted: set[str] = set()
        self.foreign: set[str] = set()

    def add(self, table: str, **row) -> None:
        self.rows.append((table, {"project": self.project, "ord": len(self.rows), **row}))

    def diagnostic(self, kind: str, file: str, line: int, detail: str) -> None:
        self.add("diagnostics", kind=kind, file=file, line=line, detail=detail)

    def skip(self, target: str, why: str) -> None:
        self.diagnostic("target-skipped", "Cargo.toml", 0, f"{target} was not scanned: {why}")

    @staticmethod
    def rel(path: str) -> str:
        return path[4:] if path.startswith("src/") else f"../{path}"

    # -- targets

    def _found(self, folder: str) -> list[tuple[str, str]]:
        """(name, entry) of folder/*.rs and folder/*/main.rs, in order of their paths."""
        out = []
        for path in self.files:
            rest = path.removeprefix(folder + "/")
            if path == rest:
                continue
            if "/" not in rest and rest.endswith(".rs"):
                out.append((rest, rest[:-3], path))
            elif rest.count("/") == 1 and rest.endswith("/main.rs"):
                out.append((rest.split("/")[0], rest.split("/")[0], path))
        return [(name, path) for _, name, path in sorted(out)]

    def targets(self) -> list[tuple[str, str, str]]:
        """(module prefix, file, kind); the crate's root comes first."""
        roots = [("main" if p.endswith("main.rs") else "lib", p) for p in ("src/lib.rs", "src/main.rs") if p in self.files] + self._found("src/bin")
        for name, path in self.manifest.bins:
            if path is None:
                if not any(n == name for n, _ in roots[1:]):
                    self.skip(f"bin `{name}`", f"declared in Cargo.toml but no src/bin/{name}.rs or src/bin/{name}/main.rs")
            elif posixpath.normpath(path) not in self.files:
                self.skip(f"bin `{name}`", f"declared path `{self.rel(posixpath.normpath(path))}` does not exist")
            elif not any(p == posixpath.normpath(path) for _, p in roots[1:]):
                roots.append((name, posixpath.normpath(path)))
        tests: list[tuple[str, str]] = []
        for name, path in self.manifest.tests:
            at = posixpath.normpath(path or f"tests/{name}.rs")
            if at not in self.files:
                self.skip(f"test `{name}`", f"declared path `{self.rel(at)}` does not exist")
            elif all(p != at for _, p in tests):
                tests.append((name, at))
        tests += [x for x in self._found("tests") if all(p != x[1] for _, p in tests)]
        for other in self.manifest.others:
            self.skip(other, "not part of the architecture; not scanned")
        if self.manifest.members:
            self.skip("workspace members", f"{', '.join(self.manifest.members)} — each is a separate crate with its own architecture; scan one of them for itself")
        own = [("", roots[0][1], "lib" if roots[0][0] == "lib" else "bin")] if roots else []
        return own + [(f"(bin:{n})", p, "bin") for n, p in roots[1:]] + [(f"(test:{n})", p, "test") for n, p in tests]

    def run(self) -> None:
        targets = self.targets()
        if not targets:
            raise Unscannable("a workspace root without a package of its own" if self.manifest.members else "no lib.rs, main.rs or src/bin/* under src")
        for prefix, path, kind in targets:
            name = prefix[prefix.index(":") + 1 : -1] if prefix else self.manifest.project.replace("-", "_")
            self.add("targets", kind=kind, name=name, file=self.rel(path))
            self.walk(prefix, path, True, kind == "test")
        for name in sorted(self.tainted):
            self.add("macro_tainted", name=name)
        for name in sorted(self.foreign):
            self.add("foreign_field_reads", name=name)

    # -- modules

    def walk(self, module: str, path: str, root: bool, test: bool) -> None:
        text = self.files[path]
        rel = self.rel(path)
        at = len(self.rows)
        try:
            tokens = rust.lex(text)
            row = {"id": module or "(crate)", "file": rel, "parent": module.rpartition("::")[0] or None if module else None, "loc": len(text.splitlines()), "symbols": 0}
            self.add("texts", path=rel, text=text)
            self.add("modules", **row)
            self.items(rust.Cursor(tokens), module, rel, path, root, test)
            self.rows[at + 1][1]["symbols"] = sum(t == "symbols" for t, _ in self.rows[at:])
        except rust.Unreadable as failure:
            del self.rows[at:]
            self.diagnostic("parse-failure", rel, failure.line, str(failure))

    def module_file(self, path: str, name: str, root: bool, declared: str | None) -> str | None:
        folder, stem = posixpath.dirname(path), posixpath.basename(path)[:-3]
        base = folder if root or stem == "mod" else f"{folder}/{stem}"
        tried = [posixpath.normpath(f"{folder}/{declared}")] if declared else []
        return next((p for p in [*tried, f"{base}/{name}.rs", f"{base}/{name}/mod.rs"] if p in self.files), None)

    # -- items

    def symbol(self, kind: str, name: str, module: str, rel: str, line: int, end: int, vis: str, attrs: rust.Attributes, test: bool, **more) -> str:
        parent = more.get("parent")
        row = {
            "id": f"{parent}::{name}" if parent else joined(module, name), "kind": kind, "name": name, "module": module, "parent": None, "file": rel, "line": line, "vis": vis, "cfg": attrs.cfg, "is_test": test,
            "derives": [], "attrs": attrs.names, "fields": [], "sig": None, "self_fields": [], "self_reads": [], "matches_on": [], "field_chains": [], "self_calls": [], "panics": [], "recv_calls": [], "loc": end - line + 1,
        }
        self.add("symbols", **(row | more))
        return row["id"]

    def edge(self, from_id: str, raw: str, kind: str, rel: str, line: int, module: str, via: str | None = None) -> None:
        self.add("raw_edges", from_id=from_id, raw=raw, kind=kind, file=rel, line=line, module=module, via=via)

    def fields(self, group: rust.Tok | None) -> list[dict]:
        out = []
        for i, part in enumerate(rust.split(group.inner) if group is not None else []):
            c = rust.Cursor(part)
            rust.attributes(c)
            rust.visibility(c)
            name = str(i)
            if group.text == "{":
                name = c.ident()
                c.take(":")
            ty = c.tokens[c.at :]
            out.append({"name": name, "ty": rust.write(ty), "ty_paths": rust.paths(ty)})
        return out

    def signature_edges(self, from_id: str, sig: dict, rel: str, line: int, module: str) -> None:
        for p in sig["params"]:
            for b in p["bounds"]:
                self.edge(from_id, b, "bound", rel, line, module, p["name"])
            for t in p["ty_paths"]:
                if t not in p["bounds"]:
                    self.edge(from_id, t, "sig", rel, line, module, p["name"])
        for t in sig["ret_paths"]:
            self.edge(from_id, t, "sig", rel, line, module, "->")
        for b in sig["generic_bounds"]:
            carriers = (p["name"] for g in sig["generics"] if b in g["bounds"] for p in sig["params"] if g["name"] in p["ty_paths"])
            self.edge(from_id, b, "bound", rel, line, module, next(carriers, None))

    def function(self, c: rust.Cursor, kind: str, module: str, rel: str, line: int, vis: str, attrs: rust.Attributes, test: bool, is_async: bool, parent: str | None = None, scanned: bool = True) -> None:
        name = c.ident()
        sig = rust.signature(c, is_async)
        body = rust.Body()
        if not c.take(";"):
            block = c.group("{")
            if scanned:
                rust.scan(block.inner, body)
        self.foreign |= body.foreign
        from_id = f"{parent}::{name}" if parent else joined(module, name)
        self.signature_edges(from_id, sig, rel, line, module)
        for path, at in body.calls:
            self.edge(from_id, path, "call", rel, at, module)
        own = {"self_fields": sorted(body.fields), "self_reads": sorted(body.reads), "self_calls": sorted(body.self_calls)} if kind == "method" else {}
        calls = [dict(zip(("recv", "method", "line", "ty", "callee"), r, strict=True)) for r in sorted(body.receivers, key=lambda r: tuple(x or "" if i != 2 else x for i, x in enumerate(r)))]
        self.symbol(
            kind, name, module, rel, line, c.line, vis, attrs, test, parent=parent, sig=sig, matches_on=sorted(body.matches), field_chains=body.chain_list(),
            panics=[{"method": m, "line": at} for m, at in body.panics], recv_calls=calls, **own,
        )

    def items(self, c: rust.Cursor, module: str, rel: str, path: str, root: bool, test: bool) -> None:
        while (t := c.peek()) is not None:
            line = t.line
            attrs = rust.attributes(c)
            if c.peek() is None:
                return
            vis = rust.visibility(c)
            gated = test or attrs.cfg_test
            is_async = self._modifiers(c)
            if c.take("mod"):
                name = c.ident()
                inner = c.peek()
                if inner is not None and inner.group("{"):
                    self.items(rust.Cursor(c.next().inner, line), joined(module, name), rel, path, root, gated)
                    continue
                c.take(";")
                file = self.module_file(path, name, root, attrs.path)
                if file is None:
                    self.diagnostic("missing-module", rel, line, f"`mod {name};` has no matching file")
                else:
                    self.walk(joined(module, name), file, False, test)
            elif c.take("use"):
                self.use(c.until(";"), module, rel, line)
                c.take(";")
            elif c.take("fn"):
                self.function(c, "fn", module, rel, line, vis, attrs, gated or attrs.test, is_async)
            elif c.is_("struct", "enum") or (c.is_("union") and (n := c.peek(1)) is not None and n.kind == "ident"):
                self.type_item(c, c.next().text, module, rel, line, vis, attrs, gated)
            elif c.take("trait"):
                self.trait(c, module, rel, line, vis, attrs, gated, test)
            elif c.take("impl"):
                self.impl(c, module, rel, line, attrs, gated)
            elif c.is_("static", "const", "type"):
                kind = c.next().text
                changing = c.take("mut")
                name = c.ident()
                c.take(":")
                ty = c.until("=", ";") if kind != "type" else []
                self.statement(c)
                fields = [{"name": name, "ty": ("mut " if changing else "") + rust.write(ty), "ty_paths": rust.paths(ty)}] if kind == "static" else []
                self.symbol(kind, name, module, rel, line, c.line, vis, attrs, test, fields=fields)
            elif c.is_("macro_rules") or (t := c.peek()).kind == "ident" or t.text == "::":
                name = rust._path_at(c)
                if not c.take("!"):
                    self.skip_item(c)
                    continue
                self.diagnostic("macro-item", rel, line, f"item-position macro `{name}!` — generated items are not modelled")
                while (g := c.peek()) is not None and g.kind != "group":
                    c.next()
                if c.peek() is not None:
                    c.next()
                c.take(";")
            else:
                self.skip_item(c)

    @staticmethod
    def _modifiers(c: rust.Cursor) -> bool:
        """Reads what may stand before fn, trait or impl; whether async was among it."""
        found = False
        while c.is_("async", "unsafe", "default", "extern", "const", "auto"):
            ahead = c.peek(1)
            if c.is_("const") and not (ahead is not None and ahead.text in ("fn", "unsafe", "async", "extern")):
                break
            if ahead is None or not (ahead.kind in ("ident", "string")) or (c.is_("extern") and ahead.text == "crate"):
                break
            found |= c.next().text == "async"
            if (s := c.peek()) is not None and s.kind == "string":
                c.next()
        return found

    @staticmethod
    def statement(c: rust.Cursor) -> None:
        while (t := c.peek()) is not None:
            c.next()
            if t.text == ";" and t.kind == "op":
                return

    @staticmethod
    def skip_item(c: rust.Cursor) -> None:
        while (t := c.peek()) is not None:
            c.next()
            if t.text == ";" or t.group("{"):
                return

    def type_item(self, c: rust.Cursor, kind: str, module: str, rel: str, line: int, vis: str, attrs: rust.Attributes, test: bool) -> None:
        name = c.ident()
        rust.where_clause(c, rust.generics(c))
        group = c.peek()
        fields: list[dict] = []
        if group is not None and group.kind == "group":
            c.next()
            if kind == "enum":
                for part in rust.split(group.inner):
                    v = rust.Cursor(part)
                    rust.attributes(v)
                    variant, inner = v.ident(), v.peek()
                    if inner is not None and inner.kind == "group":
                        fields += [f | {"name": f"{variant}::{f['name']}"} for f in self.fields(inner)]
            else:
                fields = self.fields(group)
            if group.text == "(":
                rust.where_clause(c, [])
        if kind != "enum" and (group is None or not group.group("{")):
            c.take(";")
        own = self.symbol(kind, name, module, rel, line, c.line, vis, attrs, test, derives=attrs.derives, fields=fields)
        if kind != "union":
            for f in fields:
                for p in f["ty_paths"]:
                    self.edge(own, p, "field", rel, line, module, f["name"])

    def trait(self, c: rust.Cursor, module: str, rel: str, line: int, vis: str, attrs: rust.Attributes, gated: bool, test: bool) -> None:
        name = c.ident()
        c.until("{", ";")
        block = c.peek()
        inner = c.next().inner if block is not None and block.group("{") else []
        own = self.symbol("trait", name, module, rel, line, c.line, vis, attrs, gated)
        k = rust.Cursor(inner, line)
        while (t := k.peek()) is not None:
            at, more = t.line, rust.attributes(k)
            rust.visibility(k)
            is_async = self._modifiers(k)
            if k.take("fn"):
                self.function(k, "method", module, rel, at, "public", more, test, is_async, own, scanned=False)
            elif k.peek() is not None:
                self.skip_item(k)

    def impl(self, c: rust.Cursor, module: str, rel: str, line: int, attrs: rust.Attributes, test: bool) -> None:
        if c.is_("<"):
            c.angles()
        head, of = c.until("for", "where", "{"), None
        if c.take("for"):
            if c.is_("<"):  # for<'a>
                c.angles()
            of, head = [t for t in head if t.text not in ("!", "?")], c.until("where", "{")
        rust.where_clause(c, [])
        block = c.group("{")
        names = rust.paths(head)
        self_name = names[0] if names else ""
        own = joined(module, self_name.rsplit("::", 1)[-1])
        inside = rust.Cursor(block.inner, block.line)
        methods, todo = [], []
        while (t := inside.peek()) is not None:
            at, more = t.line, rust.attributes(inside)
            if inside.peek() is None:
                break
            vis = rust.visibility(inside)
            is_async = self._modifiers(inside)
            if inside.take("fn"):
                methods.append(inside.peek().text)
                start = inside.at
                inside.until("{", ";")
                inside.next()
                todo.append((start, at, more, vis, is_async))
            elif inside.is_("!", ahead=1) or inside.is_("::", ahead=1):
                macro = rust._path_at(inside)
                self.tainted.add(own)
                self.diagnostic("macro-item", rel, at, f"`{macro}!` inside `impl {self_name}` — generated methods are not modelled")
                inside.take("!")
                inside.next()
                inside.take(";")
            else:
                self.statement(inside)
        if of is not None:
            trait = rust._path_at(rust.Cursor(of))
            self.edge(own, trait, "impl", rel, line, module)
            self.add("impls", module=module, trait_path=trait, trait_id=None, type_path=self_name, type_id=own, file=rel, line=line, is_test=test, methods=methods)
        for start, at, more, vis, is_async in todo:
            k = rust.Cursor(block.inner, at)
            k.at = start
            self.function(k, "method", module, rel, at, vis, more, test or more.test, is_async, own)

    def use(self, tokens: list[rust.Tok], module: str, rel: str, line: int) -> None:
        for path, alias in self._leaves(tokens, ""):
            if alias is None:
                self.add("globs", module=module, base=path)
                self.diagnostic("glob-import", rel, line, f"`use {path}::*` — members resolved at low confidence")
            else:
                self.add("uses", module=module, alias=alias, path=path)
                self.edge(module or "(crate)", path, "use", rel, line, module)

    def _leaves(self, tokens: list[rust.Tok], prefix: str) -> Iterator[tuple[str, str | None]]:
        """(path, alias) of each leaf of a use tree; the alias of a glob is None."""
        names = [t for t in tokens if t.text != "::" and t.kind != "doc"]
        for i, t in enumerate(names):
            if t.group("{"):
                for part in rust.split(t.inner):
                    yield from self._leaves(part, prefix)
                return
            if t.text == "*":
                yield prefix, None
                return
            if t.text == "as":
                yield prefix, names[i + 1].text
                return
            if t.text == "self" and i == len(names) - 1 and prefix:
                yield prefix, prefix.rsplit("::", 1)[-1]
                return
            prefix = joined(prefix, t.text)
        if names:
            yield prefix, names[-1].text


class Scan(NamedTuple):
    model: Model
    failures: DataFrame  # project, reason


_SCHEMAS = {
    "modules": schema.MODULES, "symbols": schema.SYMBOLS, "raw_edges": schema.RAW_EDGES, "uses": schema.USES, "globs": schema.GLOBS, "impls": schema.IMPLS, "diagnostics": schema.DIAGNOSTICS,
    "targets": schema.TARGETS, "texts": schema.TEXTS, "macro_tainted": schema.NAMES, "foreign_field_reads": schema.NAMES, "crates": "project string, self_crate string, externs array<string>", "failures": "project string, reason string",
}


def _parse(part: pd.DataFrame) -> pd.DataFrame:
    name = part["project"].iloc[0]
    one = _Project(name, dict(zip(part["path"], part["text"], strict=True)))
    one.add("crates", self_crate=one.manifest.project.replace("-", "_"), externs=list(one.manifest.externs))
    try:
        one.run()
    except Unscannable as failure:
        one.add("failures", reason=str(failure))
    return pd.DataFrame([(name, table, json.dumps(row)) for table, row in one.rows], columns=["project", "table", "row"])


def scan(files: DataFrame) -> Scan:
    """The model of every project in files (project, path relative to the crate's folder, text).

    A project is parsed as one group, thousands of them side by side; the rows of all tables
    are written once, by table. Everything after that is joins.
    """
    parsed = cut(files.groupBy("project").applyInPandas(_parse, "project string, table string, row string"), "table")
    table = lambda name: parsed.where(F.col("table") == name).select(F.from_json("row", _SCHEMAS[name]).alias("r")).select("r.*")
    symbols, modules, impls = table("symbols"), table("modules"), table("impls")
    index = cut(symbols.select("project", "id").unionByName(modules.where("not startswith(id, '(')").select("project", "id")).distinct())
    uses = table("uses").groupBy("project", "module", "alias").agg(F.max_by("path", "ord").alias("path"), F.max("ord").alias("ord"))
    scope = resolve.Scope(index, modules, uses, table("globs"), table("crates"))
    named = symbols.select("project", "module", F.explode("recv_calls").alias("c")).select("project", "module", F.explode(F.array("c.ty", "c.callee")).alias("raw"))
    scope = scope._replace(answers=cut(resolve.answered(scope, table("raw_edges"), impls.withColumnRenamed("trait_path", "raw"), named)))
    edges, unresolved = resolve.resolve_edges(table("raw_edges"), scope)
    diagnostics = table("diagnostics").unionByName(resolve.cfg_notes(symbols)).unionByName(unresolved)
    model = Model(
        modules, cut(resolve.bind_receivers(symbols, scope)), cut(edges), cut(resolve.bind_impls(impls, scope)), cut(diagnostics), table("targets"), table("texts"), table("foreign_field_reads"), table("macro_tainted")
    )
    return Scan(model, table("failures"))


def read_files(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """files of crates (name to folder), read by Spark; hidden folders and build output are left out."""
    out = None
    for name, folder in folders.items():
        base = folder.rstrip("/")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        path = F.regexp_replace("path", f"^.*?{re.escape(base)}/", "")
        kept = found.select(F.lit(name).alias("project"), path.alias("path"), F.decode("content", "UTF-8").alias("text"))
        kept = kept.where("(endswith(path, '.rs') or path = 'Cargo.toml') and not path rlike '(^|/)([.][^/]+|target|node_modules)/'")
        out = kept if out is None else out.unionAll(kept)
    if out is None:
        raise ValueError("no folders")
    return out


def source_of(model: Model, project: str, file: str) -> str | None:
    """The text of one file as it was parsed, None if there is none."""
    row = model.texts.where((F.col("project") == project) & (F.col("path") == file)).first()
    return row["text"] if row else None

"""Logical tables that every operator works on.

A code base is a set of tables, each with a `project` column so that thousands of projects share
one set. `ord` is the order of scanning; it decides between rows that share an id.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

KINDS = ("struct", "enum", "trait", "union", "type", "fn", "method", "static", "const", "module")
EDGE_KINDS = ("use", "impl", "field", "sig", "bound", "call")
TYPE_KINDS = ("struct", "enum", "union", "trait")

MODULES = "project string, ord bigint, id string, file string, parent string, loc int, symbols bigint"
SYMBOLS = (
    "project string, ord bigint, id string, kind string, name string, module string, parent string, file string, line int, "
    "vis string, cfg array<string>, is_test boolean, derives array<string>, attrs array<string>, "
    "fields array<struct<name:string,ty:string,ty_paths:array<string>>>, "
    "sig struct<params:array<struct<name:string,ty:string,ty_paths:array<string>,bounds:array<string>>>,ret:string,"
    "ret_paths:array<string>,generic_bounds:array<string>,generics:array<struct<name:string,bounds:array<string>>>,"
    "is_async:boolean,takes_self:boolean,receiver:string>, "
    "self_fields array<string>, self_reads array<string>, matches_on array<string>, field_chains array<string>, "
    "self_calls array<string>, panics array<struct<method:string,line:int>>, "
    "recv_calls array<struct<recv:string,method:string,line:int,ty:string,callee:string>>, loc int"
)
EDGES = "project string, ord bigint, from_id string, to_scope string, to_id string, to_krate string, to_path string, kind string, file string, line int, via string"
RAW_EDGES = "project string, ord bigint, from_id string, raw string, kind string, file string, line int, module string, via string"
USES = "project string, ord bigint, module string, alias string, path string"
GLOBS = "project string, ord bigint, module string, base string"
IMPLS = "project string, ord bigint, module string, trait_path string, trait_id string, type_path string, type_id string, file string, line int, is_test boolean, methods array<string>"
DIAGNOSTICS = "project string, kind string, file string, line int, detail string"
TARGETS = "project string, kind string, name string, file string"
TEXTS = "project string, path string, text string"
NAMES = "project string, name string"
COMMIT_FILES = "project string, ord bigint, hash string, author string, date string, path string, added bigint, removed bigint"


class Model(NamedTuple):
    """One set of tables; what operators do not need may be None."""

    modules: DataFrame
    symbols: DataFrame
    edges: DataFrame
    impls: DataFrame
    diagnostics: DataFrame | None = None
    targets: DataFrame | None = None
    texts: DataFrame | None = None
    foreign_field_reads: DataFrame | None = None
    macro_tainted: DataFrame | None = None

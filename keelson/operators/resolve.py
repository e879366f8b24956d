"""Name resolution: ordered candidates for each path, looked up by longest prefix.

Each raw path becomes an array of lookups in the order of the language's rules. All prefixes of
all lookups are joined to the index at once, and the smallest (candidate, prefix) that hits wins:
one equi join for every path of every project.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import BUILTIN_CRATES, extern_key, head, join_path, parent_of, prefixes, segments

#: Names that are no architecture.
IGNORED = (
    "Self", "self", "String", "str", "bool", "usize", "u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64", "f32", "f64", "char", "Vec", "Option", "Some", "None", "Result",
    "Ok", "Err", "Box", "HashMap", "HashSet", "BTreeMap", "BTreeSet", "PathBuf", "Path", "Duration", "AsRef", "AsMut", "Default", "Clone", "Copy", "Debug", "PartialEq", "Eq",
    "Hash", "Ord", "PartialOrd", "From", "Into", "Iterator", "ToString", "Display", "Drop", "Send", "Sync", "Sized", "Fn", "FnMut", "FnOnce", "Cow", "Rc", "Arc", "RefCell",
    "Cell", "Mutex", "RwLock", "OnceCell", "Ordering", "SystemTime", "Instant",
)


class Scope(NamedTuple):
    """What paths are resolved against, all with a project column."""

    index: DataFrame  # id: symbols and modules
    modules: DataFrame  # id
    uses: DataFrame  # module, alias, path
    globs: DataFrame  # module, ord, base
    crates: DataFrame  # self_crate, externs array<string>
    answers: DataFrame | None = None  # module, raw, id, full, externs of paths that are resolved already


def longest_prefix(paths: DataFrame, index: DataFrame, path: str = "path", least: str | None = None) -> DataFrame:
    """paths with hit: the longest prefix of the path that is in index (id), or null.

    A prefix shorter than the column `least` does not count, but the whole path always does.
    Each distinct path is looked up once.
    """
    keys = ["project", path, *([least] if least else [])]
    asked = paths.select(*keys).distinct()
    tried = asked.select(*keys, F.posexplode(prefixes(F.col(path), F.col(least) if least else 1)).alias("_n", "id"))
    found = tried.join(index.select("project", "id").distinct(), ["project", "id"]).groupBy(*keys).agg(F.min_by("id", "_n").alias("hit"))
    return paths.join(found, keys, "left")


def anchored(path: Column, module: Column, self_crate: Column, is_child: Column) -> Column:
    """A path of a `use` statement relative to the crate: crate, self, super and the crate's own
    name fix the base; otherwise it is relative to the module if its head is a module there (is_child)."""
    parts = segments(path)
    start = F.struct(F.lit(0).alias("n"), module.alias("base"), F.lit(True).alias("open"))

    def step(state: Column, part: Column) -> Column:
        base = F.when(part == "self", module).when(part == "super", F.coalesce(parent_of(module), F.lit(""))).when((part == "crate") | (part == self_crate), F.lit(""))
        goes = state["open"] & base.isNotNull()
        return F.struct((state["n"] + goes.cast("int")).alias("n"), F.when(goes, base).otherwise(state["base"]).alias("base"), goes.alias("open"))

    done = F.aggregate(parts, start, step)
    rest = F.array_join(F.slice(parts, done["n"] + 1, F.greatest(F.size(parts) - done["n"], F.lit(0))), "::")
    return F.when(done["n"] > 0, join_path(done["base"], rest)).when(is_child, join_path(module, path)).otherwise(path)


def _anchored_rows(rows: DataFrame, path: str, scope: Scope) -> DataFrame:
    """rows (project, module, …) with their column `path` anchored at their own module."""
    children = scope.modules.where("not startswith(id, '(')").select("project", F.col("id").alias("_child"), F.lit(True).alias("_is")).distinct()
    own = scope.crates.select("project", F.col("self_crate").alias("_own"))
    met = rows.join(own, "project", "left").withColumn("_child", join_path(F.col("module"), head(F.col(path)))).join(children, ["project", "_child"], "left")
    return met.withColumn(path, anchored(F.col(path), F.col("module"), F.col("_own"), F.coalesce("_is", F.lit(False)))).select(*rows.columns)


def candidates(raw: DataFrame, scope: Scope) -> DataFrame:
    """raw (project, raw, module) with tries, an array of (path, least) in order, and full:
    what the path is called if none of them hits."""
    uses = _anchored_rows(scope.uses.select("project", "module", "alias", "path"), "path", scope)
    globs = _anchored_rows(scope.globs.select("project", "module", "ord", "base"), "base", scope)
    globs = globs.groupBy("project", "module").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "base"))), lambda x: x["base"]).alias("globs"))
    df = raw.join(scope.crates, "project", "left").withColumn("path", F.regexp_replace("raw", "^(::)+", ""))
    module, path, own = F.col("module"), F.col("path"), F.col("self_crate")
    parts, first = segments(path), head(path)
    # a path names a use of its module by its head, and one of the root by its head or what follows the crate's name
    df = df.withColumns({"_first": first, "_root_key": F.when(first == own, F.try_element_at(parts, F.lit(2))).otherwise(first)})
    df = df.join(uses.withColumnsRenamed({"alias": "_first", "path": "_used"}), ["project", "module", "_first"], "left")
    df = df.join(uses.where("module = ''").select("project", F.col("alias").alias("_root_key"), F.col("path").alias("_root_used")), ["project", "_root_key"], "left")
    df = df.join(globs, ["project", "module"], "left").join(globs.where("module = ''").select("project", F.col("globs").alias("root_globs")), "project", "left")
    none = F.array().cast("array<string>")
    df = df.withColumns({"globs": F.coalesce("globs", none), "root_globs": F.coalesce("root_globs", none)})
    rest = lambda n: F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "::")
    one = lambda p, least: F.struct(p.alias("path"), least.cast("int").alias("least"))
    floor = F.when(module == "", 1).otherwise(F.size(segments(module)) + 1)
    fixed = (
        F.when(first == "crate", rest(1)).when(first == "self", join_path(module, rest(1))).when(first == "super", join_path(F.coalesce(parent_of(module), F.lit("")), rest(1))).when(first == own, rest(1))
    )
    alias, root_path = F.col("_used"), F.col("_root_used")
    by_alias = fixed.isNull() & alias.isNotNull()
    expanded = F.when(F.size(parts) == 1, alias).otherwise(join_path(alias, rest(1)))
    root_use = F.when(F.size(parts) <= 2, root_path).otherwise(join_path(root_path, rest(2)))
    plain = F.coalesce(fixed, path)
    via_alias = F.array(one(expanded, F.lit(1)), one(join_path(module, expanded), F.size(segments(module)) + 1))
    beside = F.concat(F.array(one(join_path(module, path), floor)), F.transform("globs", lambda g: one(join_path(g, path), F.lit(1))))
    at_root = F.concat(
        F.when(F.coalesce(root_path, F.lit("")) != "", F.array(one(root_use, F.lit(1)))).otherwise(F.array().cast("array<struct<path:string,least:int>>")),
        F.transform("root_globs", lambda g: one(join_path(g, path), F.lit(1))),
        F.array(one(plain, F.lit(1))),
    )
    tries = F.when(by_alias, via_alias).when(fixed.isNotNull(), at_root).otherwise(F.concat(beside, at_root))
    return df.select(*raw.columns, tries.alias("tries"), F.when(by_alias, expanded).otherwise(plain).alias("full"), F.coalesce("externs", none).alias("externs"))


def resolve_paths(raw: DataFrame, scope: Scope) -> DataFrame:
    """raw (project, raw, module, …) with id (the local target or null), full and externs.

    Each distinct path of a module is resolved once.
    """
    keys = ["project", "module", "raw"]
    if scope.answers is not None:
        return raw.join(scope.answers, keys, "left")
    tried = candidates(raw.select(*keys).where("raw is not null").distinct(), scope)
    each = tried.select(*keys, F.posexplode("tries").alias("_c", "t")).select(*keys, "_c", F.posexplode(prefixes(F.col("t.path"), F.col("t.least"))).alias("_n", "id"))
    hit = each.where("id != ''").join(scope.index.select("project", "id").distinct(), ["project", "id"]).groupBy(*keys).agg(F.min_by("id", F.struct("_c", "_n")).alias("id"))
    answers = tried.join(hit, keys, "left").select(*keys, "id", "full", "externs")
    return raw.join(answers, keys, "left")


def answered(scope: Scope, *paths: DataFrame) -> DataFrame:
    """What all these paths (project, module, raw) name, each distinct one once: a table for scope.answers."""
    every = paths[0].select("project", "module", "raw")
    for more in paths[1:]:
        every = every.unionByName(more.select("project", "module", "raw"))
    return resolve_paths(every.where("raw is not null").distinct(), scope)


def outcomes(resolved: DataFrame) -> DataFrame:
    """resolved with outcome: local, extern, unresolved, or none (too plain to report)."""
    first = head(F.col("full"))
    extern = first.isin(*BUILTIN_CRATES) | F.array_contains("externs", first)
    telling = (first != "") & ~first.isin(*IGNORED) & (F.contains("full", F.lit("::")) | first.rlike(r"^\p{Lu}"))
    return resolved.withColumn("outcome", F.when(F.col("id").isNotNull(), "local").when(extern, "extern").when(telling, "unresolved").otherwise("none"))


def resolve_edges(raw_edges: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """(edges, diagnostics) of raw edges."""
    done = outcomes(resolve_paths(raw_edges, scope))
    edges = done.where("outcome in ('local', 'extern')").select(
        "project", "ord", "from_id", F.col("outcome").alias("to_scope"), "id", F.when(F.col("outcome") == "extern", head(F.col("full"))).alias("to_krate"),
        F.when(F.col("outcome") == "extern", F.col("full")).alias("to_path"), "kind", "file", "line", "via",
    ).withColumnRenamed("id", "to_id")
    where = F.when(F.col("module") == "", "").otherwise(F.concat(F.lit(" in "), "module"))
    unresolved = done.where("outcome = 'unresolved'").select("project", F.lit("unresolved-path").alias("kind"), "file", "line", F.concat(F.lit("`"), "full", F.lit("` could not be placed"), where).alias("detail"))
    return edges, unresolved


def bind_impls(impls: DataFrame, scope: Scope) -> DataFrame:
    """impls with trait_id resolved, and type_id kept only where it is in the index."""
    traits = resolve_paths(impls.withColumn("raw", F.col("trait_path")), scope).withColumn("trait_id", F.col("id")).drop("id", "full", "externs", "raw")
    known = scope.index.select("project", F.col("id").alias("type_id"), F.lit(True).alias("_known")).distinct()
    return traits.join(known, ["project", "type_id"], "left").withColumn("type_id", F.when(F.col("_known"), F.col("type_id"))).select(*impls.columns)


def bind_receivers(symbols: DataFrame, scope: Scope) -> DataFrame:
    """symbols whose recv_calls name local types and callees by id, or null."""
    calls = symbols.where("size(recv_calls) > 0").select("project", "ord", "module", "parent", F.posexplode("recv_calls").alias("pos", "c"))
    both = calls.select("project", "ord", "module", "parent", "pos", F.explode(F.array(F.struct(F.lit("ty").alias("what"), F.col("c.ty").alias("raw")), F.struct(F.lit("callee").alias("what"), F.col("c.callee").alias("raw")))).alias("w")).select("project", "ord", "module", "parent", "pos", "w.*").where("raw is not null")
    own = F.when(F.col("parent").isNotNull() & (F.col("raw") == "Self"), F.col("parent"))
    member = F.col("parent").isNotNull() & F.startswith("raw", F.lit("Self::"))
    member_id = F.concat("parent", F.lit("::"), F.substr("raw", F.lit(7)))
    index = scope.index.select("project", F.col("id").alias("_member")).distinct()
    settled = both.withColumn("_member", F.when(member, member_id)).join(index.withColumn("_known", F.lit(True)), ["project", "_member"], "left")
    resolved = resolve_paths(settled, scope)
    target = F.coalesce(own, F.when(member, F.when(F.col("_known"), F.col("_member"))).otherwise(F.col("id")))
    found = resolved.select("project", "ord", "pos", "what", target.alias("target")).groupBy("project", "ord", "pos").agg(
        F.max(F.when(F.col("what") == "ty", F.col("target"))).alias("ty"), F.max(F.when(F.col("what") == "callee", F.col("target"))).alias("callee")
    )
    renewed = calls.join(found, ["project", "ord", "pos"], "left").groupBy("project", "ord").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct("c.recv", "c.method", "c.line", "ty", "callee").alias("c")))), lambda x: x["c"]).alias("_calls")
    )
    out = symbols.join(renewed, ["project", "ord"], "left")
    return out.withColumn("recv_calls", F.coalesce("_calls", "recv_calls")).select(*symbols.columns)


def cfg_notes(symbols: DataFrame) -> DataFrame:
    """One diagnostic for each file with conditional symbols: first line, count, first predicates."""
    gated = symbols.where("size(cfg) > 0").select("project", "file", "ord", "line", "cfg")
    flat = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "cfg"))), lambda x: x["cfg"])))
    by = gated.groupBy("project", "file").agg(F.min("line").alias("line"), F.count("*").alias("n"), flat.alias("p"))
    shown = F.array_join(F.transform(F.slice("p", 1, 3), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    more = F.when(F.size("p") > 3, F.concat(F.lit(" and "), (F.size("p") - 3).cast("string"), F.lit(" more"))).otherwise("")
    detail = F.concat(F.col("n").cast("string"), F.lit(" symbol(s) behind "), shown, more, F.lit(" are in the model whether or not they compile"))
    return by.select("project", F.lit("cfg-excluded").alias("kind"), "file", "line", detail.alias("detail"))


def extern_keys(edges: DataFrame) -> DataFrame:
    return edges.where("to_scope = 'extern'").withColumn("key", extern_key(F.col("to_path")))

"""Cohesion of types: components and communities of methods over the fields they touch."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import capitalise
from ..schema import Model
from .graph import greedy_communities
from .links import first_by_id

TRIVIAL_FIELDS, TRIVIAL_METHODS, WIDE_FIELDS, STRONG_Q = 5, 3, 12, 0.30
#: Crates and modules of each concern.
CONCERNS = {
    "io": ("fs", "process", "net", "env"),
    "persistence": ("rusqlite", "sqlx", "diesel", "redis"),
    "ui": ("ratatui", "crossterm", "tui", "termion"),
    "network": ("reqwest", "hyper", "ureq"),
    "serialization": ("serde_json", "toml", "serde_yaml"),
}
TYPE_KEYS = ["project", "type_ord", "type"]


def members(symbols: DataFrame) -> DataFrame:
    """One row for each method of a type that has any: the type's columns, method, m (its position),
    touch (own fields it touches), calls (own methods it calls), reads, loc.

    Types are structs outside of tests; associated functions are no methods.
    """
    types = symbols.where("kind = 'struct' and not is_test").select(
        "project", F.col("ord").alias("type_ord"), F.col("id").alias("type"), F.col("name").alias("type_name"), F.col("file").alias("type_file"), F.transform("fields", lambda f: f["name"]).alias("fields")
    )
    methods = symbols.where("parent is not null and not is_test and sig.takes_self").select(
        "project", F.col("parent").alias("type"), "ord", F.col("name").alias("method"), "self_fields", "self_calls", "self_reads", F.col("loc").alias("m_loc")
    )
    both = types.join(methods, ["project", "type"])
    own = W.partitionBy(*TYPE_KEYS)
    both = both.withColumns({"m": F.row_number().over(own.orderBy("ord")) - 1, "names": F.collect_set("method").over(own)})
    calls = F.array_except(F.array_intersect("self_calls", "names"), F.array("method"))
    return both.select(*TYPE_KEYS, "type_name", "type_file", "fields", "m", "method", F.array_intersect("self_fields", "fields").alias("touch"), calls.alias("calls"), F.col("self_reads").alias("reads"), "m_loc")


def _read_elsewhere(df: DataFrame, foreign: DataFrame | None, field: str = "field") -> DataFrame:
    if foreign is None:
        return df
    return df.join(foreign.select("project", F.col("name").alias(field)), ["project", field], "left_anti")


def unused_and_write_only(touches: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """project, type, field, state: `unused` fields are touched by no method of the type and read
    nowhere else; `write-only` ones are touched, but read neither here nor elsewhere."""
    declared = touches.select(*TYPE_KEYS, F.explode("fields").alias("field")).distinct()
    met = field_links(touches).select(*TYPE_KEYS, "field", F.lit(False).alias("read"))
    read = touches.select(*TYPE_KEYS, F.explode("reads").alias("field"), F.lit(True).alias("read"))
    used = met.unionByName(read).groupBy(*TYPE_KEYS, "field").agg(F.count_if(~F.col("read")).alias("_met"), F.count_if(F.col("read")).alias("_read"))
    none = F.lit(0).cast("bigint")
    state = F.when(F.coalesce("_met", none) == 0, "unused").when(F.coalesce("_read", none) == 0, "write-only")
    found = declared.join(used, [*TYPE_KEYS, "field"], "left").select("project", "type_ord", "type", "field", state.alias("state")).where("state is not null")
    return _read_elsewhere(found, foreign).select("project", "type", "field", "state")


def field_links(touches: DataFrame) -> DataFrame:
    """TYPE_KEYS, method, field for each touch."""
    return touches.select(*TYPE_KEYS, F.col("m").alias("method"), F.explode("touch").alias("field"))


def projection(touches: DataFrame) -> DataFrame:
    """TYPE_KEYS, a, b, w for methods a < b: shared fields, and one more if either calls the other."""
    side = lambda c: field_links(touches).withColumnRenamed("method", c)
    shared = side("a").join(side("b"), [*TYPE_KEYS, "field"]).where("a < b").select(*TYPE_KEYS, "a", "b", F.lit(1.0).alias("w"))
    names = touches.select(*TYPE_KEYS, F.col("method").alias("call"), F.col("m").alias("to"))
    called = touches.select(*TYPE_KEYS, "m", F.explode("calls").alias("call")).join(names, [*TYPE_KEYS, "call"])
    called = called.where("m != to").select(*TYPE_KEYS, F.least("m", "to").alias("a"), F.greatest("m", "to").alias("b")).distinct().withColumn("w", F.lit(1.0))
    return shared.unionByName(called).groupBy(*TYPE_KEYS, "a", "b").agg(F.sum("w").alias("w"))


def _components(n: int, links: list[tuple[int, int]]) -> list[int]:
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def one_type(fields: list[str], methods: list[str], touch: list[list[str]], calls: list[list[str]]) -> dict:
    """lcom4, lcom4_core, modularity and groups (a list of method positions each) of one type."""
    at_f = {f: i for i, f in enumerate(fields)}
    by_name: dict[str, int] = {}
    at_m: dict[str, list[int]] = {}
    for i, m in enumerate(methods):
        by_name.setdefault(m, i)
        at_m.setdefault(m, []).append(i)

    def parts(live_f: set[int], live_m: set[int]) -> int:
        links = [(at_f[f], len(fields) + m) for m in live_m for f in touch[m] if at_f[f] in live_f]
        links += [(len(fields) + by_name[c], len(fields) + m) for m in live_m for c in calls[m] if by_name[c] in live_m]
        root = _components(len(fields) + len(methods), links)
        return len({root[i] for i in live_f} | {root[len(fields) + m] for m in live_m})

    every = set(range(len(methods)))
    called = {c for cs in calls for c in cs}
    live = {i for i in every if touch[i] or calls[i] or methods[i] in called}
    weights: dict[tuple[int, int], float] = {}
    users: dict[str, list[int]] = {}
    for i in every:
        for f in sorted(set(touch[i])):
            users.setdefault(f, []).append(i)
    for found in users.values():
        for pair in combinations(found, 2):
            weights[pair] = weights.get(pair, 0.0) + 1
    for pair in {(min(i, j), max(i, j)) for i in every for c in calls[i] for j in at_m[c] if i != j}:
        weights[pair] = weights.get(pair, 0.0) + 1
    label = greedy_communities(sorted(every), weights)
    total, q = sum(weights.values()), 0.0
    names = sorted(set(label.values()))
    if total:
        inside, degree = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
        for (i, j), w in weights.items():
            degree[label[i]] += w
            degree[label[j]] += w
            if label[i] == label[j]:
                inside[label[i]] += w
        q = sum(inside[c] / total - (degree[c] / (2 * total)) ** 2 for c in names)
    groups: dict[int, list[int]] = {c: [] for c in names}
    for i in sorted(every):
        groups[label[i]].append(i)
    touched = {at_f[f] for t in touch for f in t}
    return {"lcom4": parts(set(range(len(fields))), every), "lcom4_core": parts(touched, live), "modularity": float(q), "groups": list(groups.values())}


def verdict(fields: Column, methods: Column, core: Column, q: Column, tainted: Column) -> Column:
    return (
        F.when(tainted, "excluded").when((fields < TRIVIAL_FIELDS) | (methods < TRIVIAL_METHODS), "cohesive").when(core > 1, "disconnected")
        .when((fields >= WIDE_FIELDS) & (q >= STRONG_Q), "splittable").when(fields >= WIDE_FIELDS, "tangled").otherwise("cohesive")
    )


def measures(touches: DataFrame, tainted: DataFrame | None = None) -> DataFrame:
    """One row for each type: project, type, n_fields, n_methods, lcom4, lcom4_core, modularity,
    groups, verdict. Each type is one group in Python, which holds its touches and the links
    between its methods."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("m")
        lists = lambda c: [list(x) for x in part[c]]
        found = one_type(list(part["fields"].iloc[0]), part["method"].tolist(), lists("touch"), lists("calls"))
        return pd.DataFrame([{"project": part["project"].iloc[0], "type_ord": part["type_ord"].iloc[0], "type": part["type"].iloc[0], "n_fields": len(part["fields"].iloc[0]), "n_methods": len(part), **found}])

    schema = "project string, type_ord bigint, type string, n_fields int, n_methods int, lcom4 int, lcom4_core int, modularity double, groups array<array<int>>"
    out = touches.groupBy(*TYPE_KEYS).applyInPandas(run, schema)
    if tainted is None:
        out = out.withColumn("_tainted", F.lit(False))
    else:
        out = out.join(tainted.select("project", F.col("name").alias("type"), F.lit(True).alias("_tainted")).distinct(), ["project", "type"], "left")
    return out.withColumn("verdict", verdict(F.col("n_fields"), F.col("n_methods"), F.col("lcom4_core"), F.col("modularity"), F.coalesce("_tainted", F.lit(False)))).drop("_tainted")


def memberships(measured: DataFrame) -> DataFrame:
    """TYPE_KEYS, grp, method (its position)."""
    return measured.select(*TYPE_KEYS, F.posexplode("groups").alias("grp", "ms")).select(*TYPE_KEYS, "grp", F.explode("ms").alias("method"))


def field_owners(links: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, grp: the group whose methods touch the field most, ties to the first group."""
    n = links.join(groups, [*keys, "method"]).groupBy(*keys, "field", "grp").agg(F.count("*").alias("n"))
    return n.groupBy(*keys, "field").agg(F.min(F.struct((-F.col("n")).alias("n"), "grp")).alias("best")).select(*keys, "field", F.col("best.grp").alias("grp"))


def cross_edges(links: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cross, shared: touches of fields that another group owns, and those fields."""
    owner = field_owners(links, groups, keys).withColumnRenamed("grp", "owner")
    away = links.join(groups, [*keys, "method"]).join(owner, [*keys, "field"]).where("grp != owner")
    return away.groupBy(*keys).agg(F.count("*").alias("cross"), F.sort_array(F.collect_set("field")).alias("shared"))


def labels(owners: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label: the commonest first word (before _) of a group's fields, capitalised, if two
    fields and a third of all have it; ties to the smallest; else null."""
    sizes = owners.groupBy(*keys).agg(F.count("*").alias("size"))
    first = owners.where("contains(field, '_')").groupBy(*keys, F.substring_index("field", "_", 1).alias("word")).agg(F.count("*").alias("n"))
    best = first.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("b")).select(*keys, (-F.col("b.n")).alias("n"), F.col("b.word").alias("word"))
    named = F.when((F.col("n") >= 2) & (F.col("n") * 3 >= F.col("size")), capitalise(F.col("word")))
    return sizes.join(best, keys, "left").select(*keys, named.alias("label"))


def proposals(touches: DataFrame, measured: DataFrame) -> DataFrame:
    """TYPE_KEYS, grp, name, fields, methods, loc: what disconnected, splittable and tangled types
    could be split into; a lone method without fields is no part."""
    wanted = measured.where("verdict not in ('cohesive', 'excluded')")
    groups = memberships(wanted)
    owners = field_owners(field_links(touches), groups, TYPE_KEYS)
    key = [*TYPE_KEYS, "grp"]
    declared = touches.select(*TYPE_KEYS, F.posexplode("fields").alias("pos", "field")).distinct()
    fields = owners.join(declared, [*TYPE_KEYS, "field"]).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "field"))), lambda x: x["field"]).alias("fields"))
    named = touches.select(*TYPE_KEYS, F.col("m").alias("method"), F.col("method").alias("name"), "m_loc")
    methods = groups.join(named, [*TYPE_KEYS, "method"]).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("method", "name"))), lambda x: x["name"]).alias("methods"), F.sum("m_loc").alias("loc"))
    out = methods.join(fields, key, "left").join(labels(owners, key).withColumnRenamed("label", "name"), key, "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))
    return out.where("size(fields) > 0 or size(methods) > 1").select(*key, "name", "fields", "methods", "loc")


def report(model: Model) -> DataFrame:
    """measures() with name, file, components, cross and shared, ordered by fields, methods, id."""
    touches = members(model.symbols)
    measured = measures(touches, model.macro_tainted)
    split = proposals(touches, measured).groupBy(*TYPE_KEYS).agg(F.sort_array(F.collect_list(F.struct((-F.size("fields")).alias("_n"), "methods", "name", "fields", "loc"))).alias("components"))
    crossing = cross_edges(field_links(touches), memberships(measured.where("verdict not in ('cohesive', 'excluded')")), TYPE_KEYS)
    about = touches.select(*TYPE_KEYS, "type_name", "type_file").distinct()
    out = measured.join(about, TYPE_KEYS).join(split, TYPE_KEYS, "left").join(crossing, TYPE_KEYS, "left")
    return out.orderBy("project", F.desc("n_fields"), F.desc("n_methods"), "type")


def concern_of(krate: Column, path: Column) -> Column:
    """io, persistence, ui, network, serialization or null; the language's crates go by module."""
    builtin = krate.isin("std", "core", "alloc")
    out = F.when(builtin, F.when(F.split_part(path, F.lit("::"), F.lit(2)).isin(*CONCERNS["io"]), "io"))
    for name, crates in CONCERNS.items():
        if name != "io":
            out = out.when(~builtin & krate.isin(*crates), name)
    return out


def mixed_concern(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """project, id, n, concerns: functions outside of tests that reach more than one concern."""
    hit = edges.where("to_scope = 'extern'").withColumn("concern", concern_of(F.col("to_krate"), F.col("to_path"))).where("concern is not null")
    many = hit.groupBy("project", F.col("from_id").alias("id")).agg(F.sort_array(F.collect_set("concern")).alias("concerns")).where(F.size("concerns") > 1)
    fns = first_by_id(symbols).where("kind in ('fn', 'method') and not is_test")
    return many.join(fns.select("project", "id"), ["project", "id"], "left_semi").select("project", "id", F.size("concerns").alias("n"), "concerns")

"""Classification: ordered patterns matched against symbols.

The patterns are a handful, so they become one array of the indexes that match, computed in the
scan of the symbols; no pattern table is joined and no regular expression is read from a column.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config, Pattern, valid_regex
from ..functions import ratio, starts_with_any
from .links import last_by_id


class Classified(NamedTuple):
    by_symbol: DataFrame  # project, id, pattern, layer, inherited, ambiguous
    unmatched: DataFrame  # project, ord, id, kind, file, line, name
    ports: DataFrame  # project, id: traits that the port patterns match


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _starts_with(prefixes: tuple[str, ...]):
    return lambda x: starts_with_any(x, prefixes)


def path_matches(pattern: str | None) -> Column:
    """A prefix of the file, or from ^ on a regular expression; an invalid one matches nothing."""
    if pattern is None:
        return F.lit(True)
    if pattern.startswith("^"):
        return F.col("file").rlike(pattern) if valid_regex(pattern) else F.lit(False)
    return F.startswith("file", F.lit(pattern))


def shape_matches(p: Pattern, implements_port: Column) -> Column:
    tests = []
    if p.kinds:
        tests.append(F.col("kind").isin(*p.kinds))
    if p.name is not None:
        tests.append(F.col("name").rlike(p.name) if valid_regex(p.name) else F.lit(False))
    has = lambda f: F.coalesce(F.exists("fields", lambda x: x["name"] == f), F.lit(False))
    if p.has_field is not None:
        tests.append(has(p.has_field))
    if p.not_has_field is not None:
        tests.append(~has(p.not_has_field))
    if p.derives:
        tests.append(F.size(F.array_except(F.array(*map(F.lit, p.derives)), F.coalesce("derives", F.array().cast("array<string>")))) == 0)
    if p.returns is not None:
        tests.append(F.contains(F.coalesce("sig.ret", F.lit("")), F.lit(p.returns)))
    if p.implements_port:
        tests.append(implements_port)
    return _all(tests)


def extern_reach(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """project, id, reach: extern paths of each symbol and of its methods, distinct and sorted."""
    owned = symbols.select("project", F.col("id").alias("from_id"), F.explode(F.array_compact(F.array("id", "parent"))).alias("id")).distinct()
    out = edges.where("to_scope = 'extern'").select("project", "from_id", "to_path").distinct()
    return out.join(owned, ["project", "from_id"]).groupBy("project", "id").agg(F.sort_array(F.collect_set("to_path")).alias("reach"))


def classify(symbols: DataFrame, edges: DataFrame, impls: DataFrame, config: Config) -> Classified:
    """Labels for symbols without a parent, handed down to their methods.

    Candidates match by path and shape. Those without externs, or with one that the symbol
    reaches, are decided. A single decided pattern wins; else, if all candidates share a group,
    the group's name is given and the symbol is ambiguous; else the first decided wins, else
    the first candidate. Tests are labelled before any pattern.
    """
    port_rules = [p for p in config.patterns if p.id == "port"]
    is_port = reduce(lambda a, b: a | b, [path_matches(p.path) & shape_matches(p, F.lit(False)) for p in port_rules], F.lit(False))
    ports = symbols.where(is_port).select("project", "id").distinct()
    realised = impls.where("type_id is not null and trait_id is not null").select("project", F.col("type_id").alias("id"), F.col("trait_id"))
    realised = realised.join(ports.select("project", F.col("id").alias("trait_id")), ["project", "trait_id"], "left_semi").select("project", "id").distinct()

    top = symbols.where("kind != 'module' and parent is null")
    top = top.join(realised.withColumn("_realises", F.lit(True)), ["project", "id"], "left")
    matched = [F.when(path_matches(p.path) & shape_matches(p, F.coalesce("_realises", F.lit(False))), F.lit(i)) for i, p in enumerate(config.patterns)]
    top = top.withColumn("_hits", F.array_compact(F.array(*matched)) if matched else F.array().cast("array<int>"))
    top = top.join(extern_reach(symbols, edges), ["project", "id"], "left")
    reached = [
        F.when(F.lit(not p.externs) | F.coalesce(F.exists("reach", _starts_with(p.externs)), F.lit(False)), F.lit(i)) for i, p in enumerate(config.patterns)
    ]
    top = top.withColumn("_decided", F.array_intersect("_hits", F.array_compact(F.array(*reached)) if reached else F.array().cast("array<int>")))
    names = F.array(*[F.lit(p.id) for p in config.patterns]) if matched else F.array().cast("array<string>")
    layers = F.array(*[F.lit(p.layer) for p in config.patterns]) if matched else F.array().cast("array<string>")
    groups = F.array(*[F.lit(p.group) for p in config.patterns]).cast("array<string>")
    of = lambda array, i: F.try_element_at(array, i + 1)
    first_hit, first_decided = F.try_element_at("_hits", F.lit(1)), F.try_element_at("_decided", F.lit(1))
    group = of(groups, first_hit)
    shared = group.isNotNull() & F.forall("_hits", lambda i: F.coalesce(F.try_element_at(groups, i + 1) == group, F.lit(False)))
    ambiguous = (F.size("_decided") != 1) & shared
    chosen = F.coalesce(first_decided, first_hit)
    labelled = top.select(
        "project", "ord", "id", "kind", "file", "line", "name",
        F.when(F.col("is_test"), "test").when(ambiguous, group).otherwise(of(names, chosen)).alias("pattern"),
        F.when(F.col("is_test"), "test").when(ambiguous, of(layers, first_hit)).otherwise(of(layers, chosen)).alias("layer"),
        (~F.col("is_test") & ambiguous).alias("ambiguous"),
    )
    unmatched = labelled.where("pattern is null").drop("pattern", "layer", "ambiguous")
    own = last_by_id(labelled.where("pattern is not null")).select("project", "id", "pattern", "layer", "ambiguous")
    children = symbols.where("parent is not null").select("project", "ord", "id", "parent")
    handed = children.join(own.select("project", F.col("id").alias("parent"), "pattern", "layer"), ["project", "parent"])
    handed = last_by_id(handed).select("project", "id", "pattern", "layer", F.lit(True).alias("inherited"), F.lit(False).alias("ambiguous"))
    kept = own.join(handed.select("project", "id"), ["project", "id"], "left_anti").select("project", "id", "pattern", "layer", F.lit(False).alias("inherited"), "ambiguous")
    return Classified(kept.unionByName(handed), unmatched, ports)


def coverage(symbols: DataFrame, classified: Classified) -> DataFrame:
    """project, classified, total, ports, ratio."""
    total = symbols.where("kind != 'module' and parent is null").groupBy("project").agg(F.count("*").alias("total"))
    gaps = classified.unmatched.groupBy("project").agg(F.count("*").alias("_gaps"))
    ports = classified.ports.groupBy("project").agg(F.count("*").alias("ports"))
    out = total.join(gaps, "project", "left").join(ports, "project", "left").na.fill(0)
    done = F.col("total") - F.col("_gaps")
    return out.select("project", done.alias("classified"), "total", "ports", ratio(done, F.col("total")).alias("ratio"))


def coverage_by_label(classified: Classified) -> DataFrame:
    """project, pattern, layer, n: counts by pattern and by layer, the other one null."""
    own = classified.by_symbol.where("not inherited")
    out = own.groupingSets([["project", "pattern"], ["project", "layer"]], "project", "pattern", "layer").agg(F.count("*").alias("n"))
    return out.select("project", "pattern", "layer", "n")


def gaps(classified: Classified) -> DataFrame:
    """project, file, n, example: unmatched symbols by file, with the first of them."""
    example = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "name")
    return classified.unmatched.groupBy("project", "file").agg(F.count("*").alias("n"), F.min_by(example, "ord").alias("example"))


def mixed_layer_modules(symbols: DataFrame, classified: Classified) -> DataFrame:
    """project, module, layers: modules whose own symbols (no tests) belong to several layers."""
    own = symbols.where("parent is null and not is_test").select("project", "id", "module")
    return (
        own.join(classified.by_symbol, ["project", "id"])
        .groupBy("project", "module")
        .agg(F.sort_array(F.collect_set("layer")).alias("layers"))
        .where(F.size("layers") > 1)
    )

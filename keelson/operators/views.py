"""Payloads of the views: atlas, city, layers, traffic, hotspots and the cohesion matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..functions import leaf, plural
from ..schema import Model
from . import churn, graph
from .classify import Classified
from .cohesion import field_owners



def tiers(config: Config) -> list[tuple[str, str]]:
    """(layer, title) in order, with the one for what is not classified at the end."""
    return [(x.id, x.title or x.id) for x in config.layers] + [("", "Unclassified")]


def tier_of(config: Config, layer: str = "layer") -> Column:
    out = F.when(F.lit(False), 0)
    for i, x in enumerate(config.layers):
        out = out.when(F.col(layer) == x.id, i)
    return out.otherwise(len(config.layers))


def _placed(model: Model, classified: Classified, config: Config) -> DataFrame:
    """Symbols outside of tests with pattern and tier."""
    labels = classified.by_symbol.select("project", "id", "pattern", "layer", "inherited")
    return model.symbols.where("not is_test").join(labels, ["project", "id"], "left").withColumn("tier", tier_of(config))


def atlas_nodes(model: Model, classified: Classified, config: Config) -> DataFrame:
    """project, module, n, patterns, tier of each module: its classified symbols and smallest tier."""
    own = _placed(model, classified, config).where("parent is null and pattern is not null")
    by = own.groupBy("project", "module").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("pattern")).alias("patterns"), F.min("tier").alias("tier"))
    out = model.modules.select("project", F.col("id").alias("module"), "ord").join(by, ["project", "module"], "left")
    return out.select("project", "module", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"), F.coalesce("tier", F.lit(len(config.layers))).alias("tier"))


def atlas_ports(model: Model, classified: Classified) -> DataFrame:
    """project, port, consumers, impls, fakes: who is bounded by each port and who realises it."""
    ports = model.symbols.where("kind = 'trait'").join(classified.by_symbol.where("pattern = 'port'").select("project", "id"), ["project", "id"], "left_semi").select("project", F.col("id").alias("port")).distinct()
    users = model.edges.where("kind = 'bound' and to_scope = 'local'").groupBy("project", F.col("to_id").alias("port")).agg(F.countDistinct("from_id").alias("consumers"))
    fake = F.col("is_test") | F.endswith("file", F.lit("mem.rs"))
    made = model.impls.where("trait_id is not null").groupBy("project", F.col("trait_id").alias("port")).agg(F.count_if(~fake).alias("impls"), F.count_if(fake).alias("fakes"))
    return ports.join(users, ["project", "port"], "left").join(made, ["project", "port"], "left").na.fill(0)


def city_floors(model: Model, classified: Classified, config: Config) -> DataFrame:
    """project, module, tier, floor, n: a floor for a module's functions of each tier, and one for
    each type, as high as it has methods (1 at least)."""
    own = _placed(model, classified, config).where("module != ''")
    free = own.where("kind = 'fn' and parent is null").groupBy("project", "module", "tier").agg(F.count("*").alias("n")).withColumn("floor", F.lit("functions"))
    methods = model.symbols.where("not is_test and parent is not null").groupBy("project", F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    types = own.where("kind in ('struct', 'enum', 'union', 'trait')").join(methods, ["project", "id"], "left").select("project", "module", "tier", F.greatest(F.coalesce("n", F.lit(1).cast("bigint")), F.lit(1).cast("bigint")).alias("n"), F.col("name").alias("floor"))
    return free.select("project", "module", "tier", "n", "floor").unionByName(types)


def city_towers(floors: DataFrame, config: Config) -> DataFrame:
    """project, module, height, present, absent: tiers that a module has and lacks."""
    every = F.array(*[F.lit(i) for i in range(len(config.layers) + 1)])
    out = floors.groupBy("project", "module").agg(F.sum("n").alias("height"), F.sort_array(F.collect_set("tier")).alias("present"))
    return out.withColumn("absent", F.array_except(every, "present"))


def city_findings(instances: DataFrame, symbols: DataFrame) -> DataFrame:
    """project, module, rule, n: violations by the module they start in."""
    where = symbols.groupBy("project", F.col("id").alias("from_id")).agg(F.min_by("module", "ord").alias("module"))
    return instances.join(where, ["project", "from_id"]).groupBy("project", "module", "rule").agg(F.count("*").alias("n"))


def layer_nodes(model: Model, classified: Classified, config: Config, ring: float = 10.0) -> DataFrame:
    """project, module, id, tier, x, z: modules stand on a ring, their symbols on a spiral in them."""
    own = _placed(model, classified, config).where("parent is null")
    modules = own.select("project", "module").distinct()
    angle = F.lit(2 * math.pi) * (F.row_number().over(W.partitionBy("project").orderBy("module")) - 1) / F.count("*").over(W.partitionBy("project"))
    ringed = modules.withColumn("_angle", angle)
    k = F.row_number().over(W.partitionBy("project", "module").orderBy("ord")) - 1
    turn, far = F.col("_k") * F.lit(math.pi * (3 - math.sqrt(5))), 0.6 * F.sqrt("_k")
    out = own.withColumn("_k", k).join(ringed, ["project", "module"])
    return out.select("project", "module", "id", "tier", F.round(ring * F.cos("_angle") + far * F.cos(turn), 2).alias("x"), F.round(ring * F.sin("_angle") + far * F.sin(turn), 2).alias("z"))


def layer_links(model: Model, classified: Classified, config: Config, instances: DataFrame | None = None) -> DataFrame:
    """project, a, b, kind, up, rule: distinct local edges; up if they climb to an earlier tier."""
    tier = _placed(model, classified, config).groupBy("project", "id").agg(F.max_by("tier", "ord").alias("tier"))
    side = lambda c: tier.select("project", F.col("id").alias(c), F.col("tier").alias(f"t_{c}"))
    edges = model.edges.where("to_scope = 'local'").select("project", F.col("from_id").alias("a"), F.col("to_id").alias("b"), "kind").distinct()
    out = edges.join(side("a"), ["project", "a"]).join(side("b"), ["project", "b"])
    if instances is None:
        out = out.withColumn("rule", F.lit(None).cast("string"))
    else:
        first = instances.groupBy("project", F.col("from_id").alias("a"), F.col("to_id").alias("b")).agg(F.min("rule").alias("rule"))
        out = out.join(first, ["project", "a", "b"], "left")
    return out.select("project", "a", "b", "kind", (F.col("t_b") < F.col("t_a")).alias("up"), "rule")


def entries(model: Model, classified: Classified) -> DataFrame:
    """project, id, verb, args: functions that the outside calls, and the first type of arguments."""
    handler = classified.by_symbol.where("pattern = 'command-handler'").select("project", "id", F.lit(True).alias("_handler"))
    found = model.symbols.where("kind = 'fn' and not is_test").join(handler, ["project", "id"], "left")
    found = found.where("_handler or startswith(name, 'cmd_') or (startswith(name, 'handle_') and endswith(name, '_key'))")
    keys = F.startswith("name", F.lit("handle_")) & F.endswith("name", F.lit("_key"))
    paths = F.flatten(F.transform("sig.params", lambda p: p["ty_paths"]))
    args = F.try_element_at(F.filter(paths, lambda p: leaf(p).rlike("(Args|Command|Cli)$")), F.lit(1))
    return found.select("project", "id", F.when(keys | F.contains("file", F.lit("tui")), "tui").otherwise("cli").alias("verb"), args.alias("args"))


def traffic(model: Model, classified: Classified, depth: int = graph.TRACE_DEPTH, named: bool = True) -> DataFrame:
    """project, start, node, depth, is_port, pattern: what each entry reaches over calls and bounds;
    without `named`, no node, but a row for each depth and pattern that an entry reaches."""
    links = model.edges.where("to_scope = 'local' and kind in ('call', 'bound')").select("project", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    stations = classified.by_symbol.select("project", "id", "pattern")
    return graph.trace(entries(model, classified), links, stations, stations.where("pattern = 'port'"), depth, "pattern", named)


def untraced(start: DataFrame, hops: DataFrame) -> DataFrame:
    """Entries from which nothing is reached: diagnostics, not drawn."""
    return start.join(hops.select("project", F.col("start").alias("id")), ["project", "id"], "left_anti")


def hotspot_nodes(model: Model, classified: Classified, config: Config, churn: DataFrame) -> DataFrame:
    """churn with tier (smallest) and pattern (first) of what the file holds."""
    own = _placed(model, classified, config).where("parent is null")
    by = own.groupBy("project", F.col("file").alias("path")).agg(F.min("tier").alias("tier"), F.min_by("pattern", F.when(F.col("pattern").isNotNull(), F.col("ord"))).alias("pattern"))
    return churn.join(by, ["project", "path"], "left").withColumn("tier", F.coalesce("tier", F.lit(len(config.layers))))


def matrix_offsets(groups: DataFrame, keys: list[str]) -> DataFrame:
    """groups (keys, grp, n_rows, n_cols) with row_at and col_at: where each block of the matrix starts."""
    before = W.partitionBy(*keys).orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    return groups.withColumns({"row_at": start("n_rows"), "col_at": start("n_cols")})


def narration(findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """project, sentence: counts in words; what is zero is not said."""
    n = findings.groupBy("project").agg(F.count_if(F.col("status") == "violated").alias("v"), F.count_if(F.col("status") == "unevaluable").alias("u"))
    said = n.join(coverage, "project")
    parts = F.array_compact(
        F.array(
            F.concat(F.col("classified").cast("string"), F.lit(" of "), plural(F.col("total"), "symbol"), F.lit(" classified")),
            F.when(F.col("ports") > 0, plural(F.col("ports"), "port")),
            F.when(F.col("v") > 0, F.concat(plural(F.col("v"), "rule"), F.lit(" violated"))),
            F.when(F.col("u") > 0, F.concat(plural(F.col("u"), "rule"), F.lit(" could not be evaluated"))),
        )
    )
    return said.select("project", F.concat(F.array_join(parts, "; "), F.lit(".")).alias("sentence"))


def neighbours(links: DataFrame) -> DataFrame:
    """project, module, side (in, out), other, rank: a module's links, heaviest first; links (project, a, b, w)."""
    out = links.select("project", F.col("a").alias("module"), F.lit("out").alias("side"), F.col("b").alias("other"), "w")
    back = links.select("project", F.col("b").alias("module"), F.lit("in").alias("side"), F.col("a").alias("other"), "w")
    order = W.partitionBy("project", "module", "side").orderBy(F.desc("w"), "other")
    return out.unionByName(back).withColumn("rank", F.row_number().over(order))


def atlas_shape(classified: Classified) -> DataFrame:
    """project, pattern, n: own labels by pattern, and what has none as `unclassified`."""
    own = classified.by_symbol.where("not inherited").groupBy("project", "pattern").agg(F.count("*").alias("n"))
    return own.unionByName(classified.unmatched.groupBy("project").agg(F.lit("unclassified").alias("pattern"), F.count("*").alias("n")).select("project", "pattern", "n"))


def atlas_sides(model: Model, classified: Classified) -> DataFrame:
    """project, module, side: `platform` for modules that hold infrastructure, `domain` for all others."""
    labels = classified.by_symbol.where("layer = 'infrastructure'").select("project", "id")
    platform = model.symbols.join(labels, ["project", "id"], "left_semi").select("project", "module", F.lit("platform").alias("side")).distinct()
    every = model.modules.select("project", F.col("id").alias("module")).distinct()
    return every.join(platform, ["project", "module"], "left").withColumn("side", F.coalesce("side", F.lit("domain")))


def city_entries(start: DataFrame, symbols: DataFrame) -> DataFrame:
    """project, module, n: entries by the module they lie in; start is (project, id)."""
    where = symbols.groupBy("project", "id").agg(F.min_by("module", "ord").alias("module"))
    return start.join(where, ["project", "id"]).groupBy("project", "module").agg(F.count("*").alias("n"))


def hotspot_links(links: DataFrame, modules: DataFrame) -> DataFrame:
    """project, a, b: distinct links between files, from links (project, a, b) between modules."""
    file = lambda c: modules.groupBy("project", F.col("id").alias(c)).agg(F.min_by("file", "ord").alias(f"f_{c}"))
    met = links.join(file("a"), ["project", "a"]).join(file("b"), ["project", "b"])
    return met.select("project", F.col("f_a").alias("a"), F.col("f_b").alias("b")).distinct()


def hotspot_meta(commit_files: DataFrame) -> DataFrame:
    """project, since, commits, files, available, enough, reason of a history."""
    return churn.window(commit_files).join(churn.availability(commit_files), "project")


def matrix_cells(links: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, method, field, row, col of each touch (keys, method, field): rows in order of the
    methods' groups (keys, method, grp), columns in order of the groups that own the fields."""
    rows = groups.withColumn("row", F.row_number().over(W.partitionBy(*keys).orderBy("grp", "method")) - 1).drop("grp")
    owners = field_owners(links, groups, keys)
    cols = owners.withColumn("col", F.row_number().over(W.partitionBy(*keys).orderBy("grp", "field")) - 1).drop("grp")
    return links.select(*keys, "method", "field").distinct().join(rows, [*keys, "method"]).join(cols, [*keys, "field"])


def idle_columns(links: DataFrame, groups: DataFrame, idle: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, col of the fields (keys, field) that no group owns: behind all others, by name."""
    owned = field_owners(links, groups, keys)
    n = owned.groupBy(*keys).agg(F.count("*").alias("_n"))
    alone = idle.select(*keys, "field").distinct().join(owned.select(*keys, "field"), [*keys, "field"], "left_anti").join(n, keys, "left")
    at = F.coalesce("_n", F.lit(0)) + F.row_number().over(W.partitionBy(*keys).orderBy("field")) - 1
    return alone.withColumn("col", at).drop("_n")


def traffic_filter(start: DataFrame, symbols: DataFrame, verbs: tuple[str, ...] = ("cli", "tui"), query: str = "") -> DataFrame:
    """Entries (project, id, verb) of those verbs whose verb, name, owner or module holds the query."""
    about = symbols.groupBy("project", "id").agg(F.min_by(F.struct("name", "parent", "module"), "ord").alias("_s"))
    met = start.where(F.col("verb").isin(*verbs)).join(about, ["project", "id"])
    held = F.concat_ws(" ", "verb", "_s.name", F.coalesce("_s.parent", "_s.module"), "_s.module")
    return met.where(F.contains(F.lower(held), F.lit(query.strip().lower()))).drop("_s")


def traffic_subsets(hops: DataFrame, config: Config) -> DataFrame:
    """project, start, subset: traces that pass by the service lane (`no-service`), that meet what lies
    behind the port at once (`direct`), and that cross the use-case lane (`crossing`).

    Lanes are the stations of the configured flow; hops have pattern."""
    lane = F.when(F.lit(False), 0)
    for i, station in enumerate(config.flow):
        lane = lane.when(F.col("pattern") == station, i)
    port = config.flow.index("port") if "port" in config.flow else len(config.flow)
    by = hops.withColumn("lane", lane).groupBy("project", "start").agg(
        F.bool_or(F.col("lane") == 1).alias("service"), F.bool_or(F.col("lane") > 1).alias("beyond"), F.bool_or((F.col("lane") > port) & (F.col("depth") == 1)).alias("direct"), F.bool_or(F.col("lane") == 2).alias("crossing")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = F.array_compact(F.array(F.when(yes("beyond") & ~yes("service"), "no-service"), F.when(yes("direct"), "direct"), F.when(yes("crossing"), "crossing")))
    return by.select("project", "start", F.explode(found).alias("subset"))


def endpoints(start: DataFrame, symbols: DataFrame) -> DataFrame:
    """project, id, verb, route, file, owner of each entry, as the workbench lists them."""
    about = symbols.groupBy("project", "id").agg(F.min_by(F.struct("name", "file", "parent", "module"), "ord").alias("_s"))
    return start.join(about, ["project", "id"]).select("project", "id", "verb", F.col("_s.name").alias("route"), F.col("_s.file").alias("file"), F.coalesce("_s.parent", "_s.module").alias("owner"))


def narration_slots(findings: DataFrame, coverage: DataFrame, impls: DataFrame, enforcement: DataFrame, state: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """project, slot, text: what there is to say of a project, slot by slot; a slot without anything to
    say is not there. flags is a cohesion report of flagged types."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rest = F.col("total") - F.col("classified")
    covered = coverage.select("project", F.lit("coverage").alias("slot"), F.when(rest == 0, text("All of ", plural(F.col("total"), "symbol"), " have a label.")).otherwise(
        text(F.col("classified"), " of ", plural(F.col("total"), "symbol"), " (", F.format_number(100 * F.col("ratio"), 1), " %) have a label; ", rest, " have none and stand outside of every layer.")).alias("text"))
    fake = F.col("is_test") | F.endswith("file", F.lit("mem.rs"))
    made = impls.where("trait_id is not null").groupBy("project").agg(F.count_if(~fake).alias("real"), F.count_if(fake).alias("fake"))
    seam = coverage.join(made, "project", "left").na.fill(0, ["real", "fake"])
    ports = seam.select("project", F.lit("ports").alias("slot"), F.when(F.col("ports") == 0, F.lit("There is no port, so nothing that is asked of ports could be decided.")).otherwise(
        text(plural(F.col("ports"), "port"), ", ", plural(F.col("real"), "implementation"), " and ", plural(F.col("fake"), "fake"), ".")).alias("text"))
    by = enforcement.groupBy("project").pivot("bucket", ["compiler", "checked-here", "clippy", "advisory"]).agg(F.first("n")).na.fill(0)
    held = by.select("project", F.lit("enforcement").alias("slot"), text("Of the rules the compiler holds ", F.col("compiler"), ", this check ", F.col("checked-here"), ", clippy ", F.col("clippy"), "; ", F.col("advisory"), " advise.").alias("text"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "rule"))), lambda x: x["rule"]), ", ")

    def rules(slot: str, condition: str, say) -> DataFrame:
        found = findings.where(condition).groupBy("project").agg(F.count("*").alias("k"), F.sum("n").alias("n"), listed.alias("ids"))
        return found.select("project", F.lit(slot).alias("slot"), say.alias("text"))

    dark = rules("unevaluable", "status = 'unevaluable'", text(plural(F.col("k"), "rule"), " could not be evaluated: ", F.col("ids"), "."))
    broken = rules("layering", "status = 'violated' and kind = 'decidable'", text(plural(F.col("n"), "violation"), " of ", plural(F.col("k"), "decidable rule"), ": ", F.col("ids"), "."))
    guessed = rules("heuristics", "status = 'violated' and kind = 'heuristic'", text(plural(F.col("k"), "heuristic"), " fired, which gate nothing: ", F.col("ids"), "."))
    moved = state.groupBy("project").agg(*[F.count_if(F.col("state") == x).alias(x) for x in ("known", "new", "fixed")])
    accepted = moved.select("project", F.lit("baseline").alias("slot"), text(F.col("known"), " known, ", F.col("new"), " new, ", F.col("fixed"), " fixed against what was accepted.").alias("text"))
    out = covered
    for part in (ports, held, dark, broken, guessed, accepted):
        out = out.unionByName(part)
    if flags is not None:
        widest = flags.groupBy("project").agg(F.count("*").alias("k"), F.max_by(F.struct("type", "n_fields", "n_methods", "lcom4", "modularity", "verdict"), F.struct("n_fields", "n_methods")).alias("w"))
        said = text(plural(F.col("k"), "type"), " flagged; the widest is ", F.col("w.type"), " with ", plural(F.col("w.n_fields"), "field"), ", ", plural(F.col("w.n_methods"), "method"), ", LCOM4 ", F.col("w.lcom4"), ", Q ", F.format_number("w.modularity", 3), ": ", F.col("w.verdict"), ".")
        out = out.unionByName(widest.select("project", F.lit("cohesion").alias("slot"), said.alias("text")))
    return out

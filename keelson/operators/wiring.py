"""The wiring graph: parts of a code base (bricks), what they need (sockets) and offer (studs)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import leaf, names_self
from ..plans.lineage import cut
from ..schema import Model
from .classify import Classified
from .links import last_by_id

#: Crates that are the language itself.
LANGUAGE = ("std", "core", "alloc")
SHAPES = ("struct", "enum", "union", "trait")
UNCLASSIFIED = "unclassified"


def module_label(module: Column) -> Column:
    return F.when(F.coalesce(module, F.lit("")) == "", "(crate)").otherwise(module)


def functions_id(module: Column) -> Column:
    return F.concat(module_label(module), F.lit("::*"))


def functions_name(module: Column, file: Column) -> Column:
    last = leaf(module)
    return F.when((last == "") | F.startswith(last, F.lit("(")), F.substring_index(file, "/", -1)).otherwise(F.concat(last, F.lit("::*")))


def line_end() -> Column:
    return F.col("line") + F.greatest("loc", F.lit(1)) - 1


def signature() -> Column:
    """`fn open(&self, id: i64) -> Session`, as near to written as the model keeps it."""
    params = F.transform("sig.params", lambda p: F.concat(p["name"], F.lit(": "), p["ty"]))
    args = F.concat(F.array_compact(F.array("sig.receiver")), params)
    ret = F.coalesce(F.concat(F.lit(" -> "), "sig.ret"), F.lit(""))
    written = F.concat(F.when(F.col("sig.is_async"), "async ").otherwise(""), F.lit("fn "), "name", F.lit("("), F.array_join(args, ", "), F.lit(")"), ret)
    return F.when(F.col("sig").isNull(), F.col("name")).otherwise(written)


class Wiring:
    """Bricks, calls, sockets and studs of a classified model."""

    def __init__(self, model: Model, classified: Classified, config: Config, entries: DataFrame | None = None):
        """entries: project, id, verb of functions that are called from outside."""
        self.model, self.config, self.entries = model, config, entries
        labels = cut(classified.by_symbol.select("project", "id", "pattern", "layer"))
        self.live = model.symbols.where("not is_test")
        self.labelled = self.live.join(labels, ["project", "id"], "left")
        self.types = last_by_id(self.labelled.where(F.col("kind").isin(*SHAPES)))

    def _tier(self, layer: Column) -> Column:
        out = F.when(F.lit(False), 0)
        for i, x in enumerate(self.config.layers):
            out = out.when(layer == x.id, i)
        return out.otherwise(len(self.config.layers))

    @cached_property
    def owners(self) -> DataFrame:
        """project, id, brick of each function and method; the last row of an id counts."""
        types = self.types.select("project", F.col("id").alias("parent"))
        methods = self.live.where("kind = 'method'").join(types, ["project", "parent"], "left_semi").withColumn("brick", F.col("parent"))
        free = self.live.where("kind = 'fn' and parent is null").withColumn("brick", functions_id(F.col("module")))
        return cut(last_by_id(methods.unionByName(free)))

    @property
    def bricks(self) -> DataFrame:
        """project, id, file, name, shape, module, pattern, tier, first_line, last_line.

        A module's functions are one brick and vote on its layer and pattern; ties go to the
        smallest. A type's lines run over its methods in the same file.
        """
        types = self.types.select("project", "id", "file", "name", F.col("kind").alias("shape"), module_label(F.col("module")).alias("module"), F.coalesce("pattern", F.lit(UNCLASSIFIED)).alias("pattern"), "layer", F.col("line").alias("_a"), line_end().alias("_z"))
        free = self.labelled.where("kind = 'fn' and parent is null").withColumn("brick", functions_id(F.col("module")))
        voted = free.groupBy("project", F.col("brick").alias("id")).agg(
            F.min_by("file", "ord").alias("file"), F.min_by(functions_name(F.col("module"), F.col("file")), "ord").alias("name"), F.lit("functions").alias("shape"),
            F.min_by(module_label(F.col("module")), "ord").alias("module"), F.coalesce(F.mode("pattern", True), F.lit(UNCLASSIFIED)).alias("pattern"), F.mode("layer", True).alias("layer"),
            F.min_by("line", "ord").alias("_a"), F.min_by(line_end(), "ord").alias("_z"),
        )
        all_bricks = types.unionByName(voted)
        spans = self.owners.groupBy("project", F.col("brick").alias("id"), "file").agg(F.min("line").alias("_min"), F.max(line_end()).alias("_max"))
        placed = all_bricks.join(spans, ["project", "id", "file"], "left")
        lines = [F.least("_a", "_min").alias("first_line"), F.greatest("_z", "_max").alias("last_line")]
        return placed.select("project", "id", "file", "name", "shape", "module", "pattern", self._tier(F.col("layer")).alias("tier"), *lines)

    @property
    def implementors(self) -> DataFrame:
        """project, trait_id, types, bound_to (the type, if it is the only one)."""
        types = self.types.select("project", F.col("id").alias("type_id"))
        traits = self.types.select("project", F.col("id").alias("trait_id"))
        known = self.model.impls.where("not is_test").join(types, ["project", "type_id"], "left_semi").join(traits, ["project", "trait_id"], "left_semi")
        out = known.groupBy("project", "trait_id").agg(F.sort_array(F.collect_set("type_id")).alias("types"))
        return out.withColumn("bound_to", F.when(F.size("types") == 1, F.element_at("types", 1)))

    def _bound(self, df: DataFrame, column: str) -> DataFrame:
        return df.join(self.implementors.select("project", F.col("trait_id").alias(column), "bound_to"), ["project", column], "left")

    @property
    def path_calls(self) -> DataFrame:
        """project, brick, from_method, to, to_method, line, via, is_static: calls by path."""
        own = self.owners
        start = own.select("project", F.col("id").alias("from_id"), "brick", F.col("name").alias("from_method"))
        end = own.select("project", F.col("id").alias("to_id"), F.col("brick").alias("to"), F.col("name").alias("to_method"), ((F.col("kind") == "method") & ~F.coalesce("sig.takes_self", F.lit(False))).alias("is_static"))
        built = self.types.select("project", F.col("id").alias("to_id"), F.col("id").alias("to"), F.lit(None).cast("string").alias("to_method"), F.lit(True).alias("is_static"))
        edges = self.model.edges.where("kind = 'call' and to_scope = 'local'").select("project", "from_id", "to_id", "line")
        met = edges.join(start, ["project", "from_id"]).join(end.unionByName(built), ["project", "to_id"])
        return met.where("to != brick").select("project", "brick", "from_method", "to", "to_method", "line", F.lit("path").alias("via"), "is_static").distinct()

    @property
    def named(self) -> DataFrame:
        """project, from_id, via, to_id: what a field or parameter names locally."""
        return self.model.edges.where("kind in ('field', 'sig', 'bound') and to_scope = 'local' and via is not null").select("project", "from_id", "via", "to_id").distinct()

    @property
    def returns(self) -> DataFrame:
        """project, callee, to_id: what each function hands back; a type hands back itself."""
        built = self.types.select("project", F.col("id").alias("callee"), F.col("id").alias("to_id"))
        last = last_by_id(self.model.symbols)
        said = self.model.edges.where("kind = 'sig' and via = '->' and to_scope = 'local'").select("project", F.col("from_id").alias("callee"), "to_id")
        selves = last.where(names_self(F.col("sig.ret")) & F.col("parent").isNotNull()).select("project", F.col("id").alias("callee"), F.col("parent").alias("to_id"))
        plain = said.unionByName(selves).join(built.select("project", "callee"), ["project", "callee"], "left_anti")
        return plain.unionByName(built).distinct()

    @property
    def receiver_calls(self) -> DataFrame:
        """One row for each call on a receiver: project, id, pos, brick, from_method, method, line,
        via, outcome (followed, library, ambiguous, unread), to.

        The receiver is what is declared nearest: a field, a local's type, what a callee returns,
        a parameter. A call is followed if exactly one brick it may be has the method.
        """
        calls = self.owners.select("project", "ord", "id", "parent", "brick", F.col("name").alias("from_method"), F.transform("sig.params", lambda p: p["name"]).alias("params"), F.posexplode("recv_calls").alias("pos", "c"))
        recv = F.col("c.recv")
        field = F.startswith(recv, F.lit("self."))
        is_param = F.coalesce(F.array_contains("params", recv), F.lit(False))
        via = (
            F.when(field & F.col("parent").isNotNull(), "field").when(field, "none").when(F.col("c.ty").isNotNull(), "type").when(F.col("c.callee").isNotNull(), F.when(recv == "()", "chain").otherwise("local"))
            .when(is_param, "param").otherwise("unread")
        )
        calls = calls.withColumn("via", via).where("via != 'none'").withColumns({"method": F.col("c.method"), "line": F.col("c.line"), "ty": F.col("c.ty"), "callee": F.col("c.callee"), "from_id": F.when(field, F.col("parent")).otherwise(F.col("id")), "name": F.regexp_replace(recv, r"^self\.", "")}).drop("c", "params")
        key = ["project", "id", "pos"]
        named = self.named.withColumnRenamed("via", "name")
        targets = (
            calls.where("via in ('field', 'param')").join(named, ["project", "from_id", "name"]).select(*key, "method", "to_id")
            .unionByName(calls.where("via = 'type'").select(*key, "method", F.col("ty").alias("to_id")))
            .unionByName(calls.where("via in ('local', 'chain')").join(self.returns, ["project", "callee"]).select(*key, "method", "to_id"))
        )
        has = self.owners.where("kind = 'method'").select("project", F.col("brick").alias("to_id"), F.col("name").alias("method")).distinct()
        hits = targets.join(has, ["project", "to_id", "method"]).groupBy(*key).agg(F.collect_set("to_id").alias("hits"))
        out = calls.join(hits, key, "left")
        n = F.coalesce(F.size("hits"), F.lit(0))
        outcome = F.when(F.col("via") == "unread", "unread").when(n < 1, "library").when(n == 1, "followed").otherwise("ambiguous")
        return out.select(*key, "brick", "from_method", "method", "line", F.when(F.col("via") == "type", "local").otherwise(F.col("via")).alias("via"), outcome.alias("outcome"), F.when(n == 1, F.element_at("hits", 1)).alias("to"))

    @property
    def calls(self) -> DataFrame:
        """project, brick, from_method, to, to_method, line, via, is_static, bound_to."""
        followed = self.receiver_calls.where("outcome = 'followed' and to != brick").select("project", "brick", "from_method", "to", F.col("method").alias("to_method"), "line", "via", F.lit(False).alias("is_static"))
        return self._bound(self.path_calls.unionByName(followed).distinct(), "to")

    @property
    def slots(self) -> DataFrame:
        """project, brick, slot (order), id, name, ty, ty_paths, line, via: fields, then parameters."""
        own = self.types.where("size(fields) > 0").select("project", F.col("id").alias("brick"), "id", "line", "file", "ord", F.lit("field").alias("via"), F.posexplode("fields").alias("pos", "f"), F.array().cast("array<string>").alias("generics"))
        taken = self.owners.select("project", "brick", "id", "line", "file", "ord", F.lit("param").alias("via"), F.posexplode("sig.params").alias("pos", "f"), F.transform("sig.generics", lambda g: g["name"]).alias("generics"))
        order = F.struct((F.col("via") == "param").alias("p"), F.col("ord"), F.col("pos")).alias("slot")
        cols = ["project", "brick", order, "id", "file", F.col("f.name").alias("name"), F.col("f.ty").alias("ty"), F.col("f.ty_paths").alias("ty_paths"), "line", "via", "generics"]
        return own.select(*cols).unionByName(taken.select(*cols))

    @property
    def sockets(self) -> DataFrame:
        """project, brick, status (port, resolved, external, unresolved), to, external, prop, ty, line, via, bound_to, why.

        Sockets of a brick to the same thing are one, with the names joined in order; `field`
        wins over `param`. The language's own crates and a brick's own type are none.
        """
        edges = self.model.edges.where("kind in ('field', 'sig', 'bound') and via is not null").select("project", F.col("from_id").alias("id"), F.col("via").alias("name"), "to_scope", "to_id", "to_krate", "to_path", F.col("ord").alias("e_ord"))
        met = self.slots.join(edges, ["project", "id", "name"]).join(self.types.select("project", F.col("id").alias("to_id"), "kind"), ["project", "to_id"], "left")
        local = F.col("to_scope") == "local"
        status = F.when(local & (F.col("kind") == "trait"), "port").when(local & F.col("kind").isNotNull(), "resolved").when(~local & ~F.col("to_krate").isin(*LANGUAGE), "external")
        met = met.withColumn("status", status).where("status is not null and not (to_scope = 'local' and to_id = brick)")
        order = F.struct("slot", "e_ord")
        names = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("slot", "e_ord", "name"))), lambda x: x["name"])), ", ")
        merged = met.groupBy("project", "brick", "status", F.when(local, F.col("to_id")).alias("to"), F.when(~local, F.col("to_path")).alias("external")).agg(
            names.alias("prop"), F.min_by("ty", order).alias("ty"), F.min_by("line", order).alias("line"), F.min("via").alias("via")
        )
        merged = self._bound(merged, "to").withColumn("bound_to", F.when(F.col("status") == "port", F.col("bound_to"))).withColumn("why", F.lit(None).cast("string"))
        return merged.unionByName(self._unresolved(), allowMissingColumns=True)

    def _unresolved(self) -> DataFrame:
        if self.model.diagnostics is None:
            return self.slots.limit(0).select("project", "brick", F.lit("unresolved").alias("status"), F.col("name").alias("prop"), "ty", "line", "via")
        paths = self.model.diagnostics.where("kind = 'unresolved-path'").select("project", "file", "line", F.col("detail").alias("why"), F.split_part("detail", F.lit("`"), F.lit(2)).alias("path"))
        met = self.slots.join(paths, ["project", "file", "line"]).where(~F.coalesce(F.array_contains("generics", F.col("path")), F.lit(False)))
        met = met.where(F.exists("ty_paths", lambda p: leaf(p) == leaf(F.col("path"))))
        return met.select("project", "brick", F.lit("unresolved").alias("status"), F.col("name").alias("prop"), "ty", "line", "via", "why")

    @property
    def studs(self) -> DataFrame:
        """project, brick, id, name, sig, kind, public, grip, of_trait, is_static: what bricks offer.

        grip tells who holds a public function: another brick, a route from outside, a caller of
        the trait it implements (port), a framework behind a foreign trait, or nobody (unseen).
        """
        types = self.types.select("project", F.col("id").alias("brick"), F.col("kind").alias("shape"))
        methods = self.model.impls.where("not is_test and type_id is not null").join(self.types.select("project", F.col("id").alias("type_id")), ["project", "type_id"], "left_semi")
        methods = methods.select("project", F.col("type_id").alias("brick"), F.explode("methods").alias("name"), "ord", "trait_path", "trait_id")
        of = methods.groupBy("project", "brick", "name").agg(F.max_by(F.struct("trait_path", "trait_id"), "ord").alias("t"))
        held = self.calls.where("to_method is not null").select("project", F.col("to").alias("brick"), F.col("to_method").alias("name")).distinct()
        out = self.owners.join(types, ["project", "brick"], "left").join(of, ["project", "brick", "name"], "left").withColumns({"trait_path": F.col("t.trait_path"), "trait_id": F.col("t.trait_id")})
        out = out.join(held.withColumn("by_brick", F.lit(True)), ["project", "brick", "name"], "left")
        out = out.join(held.select("project", F.col("brick").alias("trait_id"), "name", F.lit(True).alias("by_port")), ["project", "trait_id", "name"], "left")
        if self.entries is not None:
            out = out.join(self.entries.select("project", "id", F.lit(True).alias("route")).distinct(), ["project", "id"], "left")
        else:
            out = out.withColumn("route", F.lit(None).cast("boolean"))
        declared = F.coalesce(F.col("shape") == "trait", F.lit(False))
        public = declared | F.col("trait_path").isNotNull() | (F.col("vis") != "private")
        grip = F.when(~public, None).when(F.col("by_brick"), "brick").when(F.col("route"), "route").when(F.col("trait_id").isNotNull(), F.when(F.col("by_port"), "port").otherwise("unseen")).when(F.col("trait_path").isNotNull(), "framework").otherwise("unseen")
        kind = F.when(declared, "declared").when(F.col("kind") == "fn", "function").otherwise("method")
        return out.select("project", "brick", "id", "name", signature().alias("sig"), kind.alias("kind"), public.alias("public"), grip.alias("grip"), F.col("trait_path").alias("of_trait"), ((F.col("kind") == "method") & ~F.coalesce("sig.takes_self", F.lit(False))).alias("is_static"))

    @property
    def wires(self) -> DataFrame:
        return self.sockets.where("status in ('port', 'resolved')").select("project", F.col("brick").alias("from_brick"), "to", "prop", "via", "bound_to")

    @property
    def meta(self) -> DataFrame:
        """project, counter, n: sockets by status, studs by grip, receiver calls by outcome."""
        count = lambda df, kind, c: df.groupBy("project", F.concat(F.lit(f"{kind}."), c).alias("counter")).agg(F.count("*").alias("n"))
        return count(self.sockets, "socket", "status").unionByName(count(self.studs.where("public"), "stud", "grip")).unionByName(count(self.receiver_calls, "call", "outcome"))

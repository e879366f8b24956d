"""Conformance rules: 24 premises and predicates over a classified model.

Each rule yields instances (rule, from_id, to_id, file, line, detail); a premise that does not
hold makes a rule unevaluable, which is not the same as passing. All instances are one union,
all premises one aggregate for each project.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import ends_with_any, head, leaf, starts_with_any
from ..plans.lineage import cut
from ..schema import Model
from . import churn as churn_ops
from .classify import Classified, mixed_layer_modules
from .links import last_by_id

LEVELS = ("use-case", "service", "store", "command-handler")
CONCRETE = ("store", "adapter", "infra-impl")
#: Cell types that make a static mutable.
CELLS = ("Mutex", "RwLock", "OnceCell", "OnceLock", "LazyLock", "RefCell", "Cell", "Atomic")
WIDEST_TRAIT = 12
#: SQL conditions on symbols with their labels.
USE_CASE_DIR = "kind = 'fn' and contains(file, 'domain/use_cases/') and not is_test"
RENDERS = "kind in ('fn', 'method') and not is_test and (startswith(name, 'render_') or startswith(name, 'draw_') or coalesce(pattern, '') = 'view-model')"


@dataclass(frozen=True)
class Rule:
    id: str
    tier: str
    kind: str = "decidable"
    gate: bool = True


#: The rules in the order of reports.
RULES = (
    Rule("domain-no-io", "lint"),
    Rule("domain-no-application", "lint"),
    Rule("infra-no-application", "lint"),
    Rule("concrete-outside-root", "lint"),
    Rule("call-through-port", "trait"),
    Rule("flow-skip", "lint"),
    Rule("no-same-level", "convention"),
    Rule("port-signature-purity", "trait"),
    Rule("no-global-mut", "convention"),
    Rule("dto-in-domain", "lint"),
    Rule("use-case-verb", "lint"),
    Rule("time-injected", "convention"),
    Rule("converter-is-pure", "convention"),
    Rule("port-has-fake", "convention", gate=False),
    Rule("mixed-layer-module", "convention"),
    Rule("dependency-inversion", "trait"),
    Rule("panic-in-domain", "clippy"),
    Rule("untested-port", "convention", gate=False),
    Rule("churn-concentration", "convention", gate=False),
    Rule("store-decides", "convention", "heuristic", False),
    Rule("handler-decides", "convention", "heuristic", False),
    Rule("service-wraps-one", "convention", "heuristic", False),
    Rule("fat-trait", "convention", "heuristic", False),
    Rule("renders-off-store", "convention", "heuristic", False),
)


class Evaluation:
    """The rules over one model.

    Labels and the edges with the labels of their ends are written once; the rest is lazy."""

    def __init__(self, model: Model, classified: Classified, config: Config, commit_files: DataFrame | None = None, deps: DataFrame | None = None):
        self.model, self.config, self.classified = model, config, classified
        self.commit_files, self.deps = commit_files, deps
        labels = classified.by_symbol.select("project", "id", "pattern", F.col("layer").alias("own_layer"), "inherited")
        directory = reduce(lambda c, x: c.when(F.startswith("file", F.lit(x[0])), x[1]), config.layer_dirs(), F.when(F.lit(False), ""))
        placed = last_by_id(model.symbols).join(labels, ["project", "id"], "left")
        #: project, id, pattern, own_layer, layer (by label, else by directory) of each id
        # classified once, written, and read by every rule
        self.where = cut(placed.select("project", "id", "pattern", "own_layer", "inherited", F.coalesce("own_layer", directory).alias("layer")))
        self.labels = self.where.where("pattern is not null").select("project", "id", "pattern", "own_layer", "inherited")
        #: every symbol row with the labels of its id
        self.symbols = model.symbols.join(self.where, ["project", "id"], "left")
        self.ports = self.symbols.where("kind = 'trait' and pattern = 'port'")

    # -- shared shapes

    @staticmethod
    def _out(rule: str, df: DataFrame, to: Column, detail: Column, line: Column | str = "line", from_id: str = "from_id") -> DataFrame:
        return df.select("project", F.lit(rule).alias("rule"), F.col(from_id).alias("from_id"), to.cast("string").alias("to_id"), "file", (F.col(line) if isinstance(line, str) else line).cast("int").alias("line"), detail.alias("detail"))

    def _ends(self, edges: DataFrame, both: bool = True) -> DataFrame:
        """edges with from_layer, from_pattern (and to_layer, to_pattern), null where unknown."""
        side = lambda p: self.where.select("project", F.col("id").alias(f"{p}_id"), F.col("layer").alias(f"{p}_layer"), F.col("pattern").alias(f"{p}_pattern"), F.lit(True).alias(f"{p}_known"))
        out = edges.join(side("from"), ["project", "from_id"], "left")
        return out.join(side("to"), ["project", "to_id"], "left") if both else out

    @cached_property
    def _local(self) -> DataFrame:
        return cut(self._ends(self.model.edges.where("to_scope = 'local'")))

    @cached_property
    def _extern(self) -> DataFrame:
        return cut(self._ends(self.model.edges.where("to_scope = 'extern'"), both=False))

    def _symbol(self, rule: str, df: DataFrame, detail: Column, to: Column | None = None) -> DataFrame:
        return self._out(rule, df, F.lit("") if to is None else to, detail, from_id="id")

    # -- the rules

    def domain_no_io(self) -> DataFrame:
        io = self.config.group("io") + self.config.group("render")
        hit = self._extern.where("from_known and from_layer = 'domain'").where(starts_with_any(F.col("to_path"), io))
        named = last_by_id(self.model.symbols).select("project", F.col("id").alias("from_id"), "name")
        return self._out("domain-no-io", hit.join(named, ["project", "from_id"]), F.col("to_path"), F.concat("name", F.lit(" uses "), "to_path"))

    def layer_reference(self, rule: str, lower: str, upper: str) -> DataFrame:
        hit = self._local.where((F.col("kind") != "impl") & (F.col("from_layer") == lower) & (F.col("to_layer") == upper))
        return self._out(rule, hit, F.col("to_id"), F.concat("from_id", F.lit(" refers to "), "to_id"))

    def concrete_outside_root(self) -> DataFrame:
        inside = F.coalesce(F.col("from_layer").isin("infrastructure", "composition-root", "test"), F.lit(False))
        concrete = self.labels.where(F.col("pattern").isin(*CONCRETE) & ~F.col("inherited")).select("project", F.col("id").alias("to_id"))
        hit = self._local.where((F.col("kind") != "impl") & ~inside).join(concrete, ["project", "to_id"], "left_semi")
        return self._out("concrete-outside-root", hit, F.col("to_id"), F.concat("from_id", F.lit(" depends on the concrete "), "to_id"))

    def call_through_port(self) -> DataFrame:
        concrete = self.labels.where(F.col("pattern").isin(*CONCRETE)).groupBy("project", leaf(F.col("id")).alias("leaf")).agg(F.min("id").alias("concrete"))
        callers = self.symbols.where(F.col("pattern").isin("use-case", "service", "command-handler"))
        params = callers.select("project", "id", "file", "line", F.explode("sig.params").alias("p")).where(F.coalesce(F.size("p.bounds"), F.lit(0)) < 1)
        wanted = params.select("project", "id", "file", "line", "p", F.explode("p.ty_paths").alias("want")).withColumn("leaf", leaf(F.col("want")))
        return self._symbol("call-through-port", wanted.join(concrete, ["project", "leaf"]), F.concat(F.lit("concrete type behind `"), "p.name", F.lit(": "), "p.ty", F.lit("`")), F.col("concrete"))

    def _station(self, pattern: str) -> Column:
        return reduce(lambda c, x: c.when(F.col(pattern) == x[1], x[0]), enumerate(self.config.flow), F.when(F.lit(False), 0))

    def flow_skip(self) -> DataFrame:
        seam = self.config.flow.index("port") if "port" in self.config.flow else -1
        hit = self._local.where((F.col("kind") != "impl") & (self._station("from_pattern") < seam) & (self._station("to_pattern") > seam))
        return self._out("flow-skip", hit, F.col("to_id"), F.concat("from_pattern", F.lit(" goes past the port to "), "to_pattern"))

    def no_same_level(self) -> DataFrame:
        hit = self._local.where((F.col("kind") == "call") & (F.col("from_id") != F.col("to_id")) & (F.col("from_pattern") == F.col("to_pattern")) & F.col("from_pattern").isin(*LEVELS))
        return self._out("no-same-level", hit, F.col("to_id"), F.concat(F.lit("one "), "from_pattern", F.lit(" calls another")))

    def _port_methods(self) -> DataFrame:
        return self.model.symbols.join(self.ports.select("project", F.col("id").alias("parent"), F.col("ord").alias("port_ord")), ["project", "parent"])

    def port_signature_purity(self) -> DataFrame:
        leaks = self.model.edges.where("kind = 'sig' and to_scope = 'extern' and not startswith(to_path, 'std::') and not startswith(to_path, 'core::')")
        hit = self._port_methods().join(leaks.select("project", F.col("from_id").alias("id"), "to_path"), ["project", "id"])
        return self._symbol("port-signature-purity", hit, F.concat(F.lit("`"), "name", F.lit("` has "), "to_path", F.lit(" in its signature")), F.col("to_path"))

    def no_global_mut(self) -> DataFrame:
        ty = F.try_element_at("fields", F.lit(1))["ty"]
        cell = F.try_element_at(F.filter(F.array(*map(F.lit, CELLS)), lambda c: F.contains(F.col("_ty"), c)), F.lit(1))
        why = F.when(F.startswith("_ty", F.lit("mut ")), "static mut").otherwise(F.concat(F.lit("static with a "), cell))
        hit = self.model.symbols.where("kind = 'static' and not is_test").withColumn("_ty", ty).withColumn("_why", why).where("_why is not null")
        return self._symbol("no-global-mut", hit, F.concat("name", F.lit(" is a "), "_why", F.lit(" (`"), "_ty", F.lit("`)")))

    def dto_in_domain(self) -> DataFrame:
        hit = self.symbols.where(F.col("layer") == "domain").where(ends_with_any(F.col("name"), self.config.forbid_in_domain))
        return self._symbol("dto-in-domain", hit, F.concat(F.lit("`"), "name", F.lit("` carries a transport suffix")))

    def use_case_verb(self) -> DataFrame:
        hit = self.symbols.where(USE_CASE_DIR).where("coalesce(pattern, '') != 'use-case'")
        return self._symbol("use-case-verb", hit, F.concat(F.lit("`"), "name", F.lit("` starts with none of the verbs")))

    def time_injected(self) -> DataFrame:
        inside = F.coalesce(F.col("from_layer").isin("infrastructure", "test"), F.lit(False))
        hit = self._extern.where(~inside).where(starts_with_any(F.col("to_path"), self.config.group("time")))
        return self._out("time-injected", hit, F.col("to_path"), F.concat("from_id", F.lit(" asks "), "to_path", F.lit(" for the time")))

    def converter_is_pure(self) -> DataFrame:
        converters = self.symbols.where("pattern = 'converter'")
        takes = converters.where(F.exists("sig.params", lambda p: F.size(p["bounds"]) > 0))
        fails = converters.where(F.startswith("sig.ret", F.lit("Result")))
        dirty = self.model.edges.where("to_scope = 'extern'").where(starts_with_any(F.col("to_path"), self.config.group("io")))
        reaches = converters.join(dirty.select("project", F.col("from_id").alias("id")), ["project", "id"], "left_semi")
        say = lambda df, what: self._symbol("converter-is-pure", df, F.concat(F.lit("`"), "name", F.lit(f"` {what}")))
        return say(takes, "is given a port").unionAll(say(fails, "may fail")).unionAll(say(reaches, "does I/O"))

    def port_has_fake(self) -> DataFrame:
        fake = F.col("is_test") | F.endswith("file", F.lit("mem.rs")) | F.contains("file", F.lit("/fake"))
        impls = self.model.impls.where("trait_id is not null").groupBy("project", F.col("trait_id").alias("id")).agg(F.count("*").alias("n"), F.bool_or(fake).alias("fake"))
        hit = self.ports.join(impls, ["project", "id"], "left").where("not coalesce(fake, false)")
        some = F.concat(F.lit("`"), "name", F.lit("` has "), F.col("n").cast("string"), F.lit(" implementation(s) and no fake among them"))
        return self._symbol("port-has-fake", hit, F.when(F.col("n").isNull(), F.concat(F.lit("`"), "name", F.lit("` has no implementation"))).otherwise(some))

    def mixed_layer_module(self) -> DataFrame:
        files = self.model.modules.groupBy("project", F.col("id").alias("module")).agg(F.min_by("file", "ord").alias("file"))
        hit = mixed_layer_modules(self.model.symbols, self.classified).join(files, ["project", "module"], "left").withColumn("file", F.coalesce("file", F.lit("")))
        return self._out("mixed-layer-module", hit, F.lit(""), F.concat("module", F.lit(" mixes "), F.array_join("layers", " and ")), F.lit(1), "module")

    def _inversions(self) -> DataFrame:
        own = self.labels.select("project", "id", "own_layer")
        bound = self.model.impls.where("trait_id is not null and type_id is not null")
        return bound.join(own.withColumnsRenamed({"id": "trait_id", "own_layer": "tl"}), ["project", "trait_id"], "left").join(own.withColumnsRenamed({"id": "type_id", "own_layer": "cl"}), ["project", "type_id"], "left")

    def dependency_inversion(self) -> DataFrame:
        """The violations of a project, or where it has none what upholds the rule."""
        found = self._inversions()
        bad = found.where("tl = 'infrastructure' and cl = 'domain'")
        good = found.where("tl = 'domain' and cl in ('infrastructure', 'test')").join(bad.select("project").distinct(), "project", "left_anti")
        bad = self._out("dependency-inversion", bad, F.col("trait_id"), F.concat(F.lit("domain type realises infrastructure trait "), "trait_path"), from_id="type_id")
        return bad.unionAll(self._out("dependency-inversion", good, F.col("trait_id"), F.concat("type_path", F.lit(" realises "), "trait_path"), from_id="type_id"))

    def panic_in_domain(self) -> DataFrame:
        hit = self.symbols.where("layer = 'domain'").select("project", "id", "file", "name", F.explode("panics").alias("p"))
        return self._out("panic-in-domain", hit, F.col("p.method"), F.concat(F.lit("`"), "id", F.lit("` may stop at "), "p.method"), F.col("p.line"), "id")

    def untested_port(self) -> DataFrame:
        tests = self.model.symbols.where("is_test").select("project", F.col("id").alias("from_id")).distinct()
        called = self.model.edges.where("kind = 'call' and to_scope = 'local'").join(tests, ["project", "from_id"], "left_semi").select("project", F.col("to_id").alias("id"))
        faked = self.model.impls.where("is_test and trait_id is not null").select("project", F.col("trait_id").alias("id"))
        hit = self.ports.join(called.unionAll(faked), ["project", "id"], "left_anti")
        n = self.model.targets.where("kind = 'test'").groupBy("project").agg(F.count("*").alias("_targets"))
        say = F.concat(F.lit("neither called nor realised in "), F.coalesce("_targets", F.lit(0)).cast("string"), F.lit(" test target(s)"))
        return self._symbol("untested-port", hit.join(n, "project", "left"), say)

    def churn_concentration(self) -> DataFrame:
        files = churn_ops.scored(churn_ops.per_file(self.commit_files), self.deps)
        window = churn_ops.window(self.commit_files).withColumnRenamed("commits", "total").select("project", "since", "total", F.col("files").alias("n_files"))
        found = churn_ops.concentration(files).join(window, "project").withColumn("file", F.col("path"))
        module = self.model.modules.groupBy("project", "file").agg(F.min_by("id", "ord").alias("module"))
        first = self.model.symbols.where("not is_test").groupBy("project", "module").agg(F.min_by("line", "ord").alias("first_line"))
        found = found.join(module, ["project", "file"], "left").join(first, ["project", "module"], "left")
        say = F.concat(
            F.round("share", 0).cast("int").cast("string"), F.lit("% of all churn; "), F.col("deps").cast("string"), F.lit(" of "), F.col("n_files").cast("string"),
            F.lit(" files depend on it; "), F.col("total").cast("string"), F.lit(" commit(s) since "), F.col("since").cast("string"),
        )
        return self._out("churn-concentration", found, F.lit(""), say, F.coalesce("first_line", F.lit(1)), "path")

    @property
    def _domain_enums(self) -> DataFrame:
        return self.symbols.where("kind = 'enum' and layer = 'domain'").select("project", F.col("name").alias("enum")).distinct()

    def _branches(self, rule: str, symbols: DataFrame) -> DataFrame:
        heads = symbols.select("project", "id", "file", "line", "name", F.explode(F.array_distinct(F.transform("matches_on", head))).alias("enum"))
        return self._symbol(rule, heads.join(self._domain_enums, ["project", "enum"]), F.concat(F.lit("`"), "name", F.lit("` decides on "), "enum"), F.col("enum"))

    def _store_methods(self) -> DataFrame:
        return self.symbols.where(F.col("pattern").isin(*CONCRETE) & (F.col("kind") == "method"))

    def store_decides(self) -> DataFrame:
        methods = self._store_methods().where("sig is not null")
        returned = methods.select("project", "id", "file", "line", "name", F.explode("sig.ret_paths").alias("p")).withColumn("enum", leaf(F.col("p"))).join(self._domain_enums, ["project", "enum"])
        say = F.concat(F.lit("`"), "name", F.lit("` hands back the domain enum "), "enum")
        return self._symbol("store-decides", returned, say, F.col("enum")).unionAll(self._branches("store-decides", methods))

    def handler_decides(self) -> DataFrame:
        return self._branches("handler-decides", self.symbols.where("pattern = 'command-handler'"))

    def service_wraps_one(self) -> DataFrame:
        calls = self._local.where("kind = 'call' and to_pattern = 'use-case'").groupBy("project", F.col("from_id").alias("id")).agg(F.count("*").alias("n"), F.min("to_id").alias("to_id")).where("n = 1")
        hit = self.symbols.where("pattern = 'service' and kind in ('fn', 'method')").join(calls, ["project", "id"])
        return self._symbol("service-wraps-one", hit, F.concat(F.lit("`"), "name", F.lit("` calls a single use-case")), F.col("to_id"))

    def fat_trait(self) -> DataFrame:
        n = self.model.symbols.where("parent is not null").groupBy("project", F.col("parent").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > WIDEST_TRAIT)
        say = F.concat(F.lit("`"), "name", F.lit("` has "), F.col("n").cast("string"), F.lit(f" methods, more than {WIDEST_TRAIT}"))
        return self._symbol("fat-trait", self.ports.join(n, ["project", "id"]), say)

    def renders_off_store(self) -> DataFrame:
        hit = self.symbols.where(RENDERS).select("project", "id", "file", "line", "name", F.explode("field_chains").alias("chain"))
        return self._symbol("renders-off-store", hit, F.concat(F.lit("`"), "name", F.lit("` walks `"), "chain", F.lit("`")), F.col("chain"))

    # -- the report

    def instances(self, only: tuple[str, ...] = ()) -> DataFrame:
        """project, rule, from_id, to_id, file, line, detail of all rules (written once), or of those named."""
        return self._union(only) if only else self._all

    @cached_property
    def _all(self) -> DataFrame:
        return cut(self._union(()))

    def _union(self, only: tuple[str, ...]) -> DataFrame:
        makers = {r.id: getattr(self, r.id.replace("-", "_"), None) for r in RULES}
        makers["domain-no-application"] = lambda: self.layer_reference("domain-no-application", "domain", "application")
        makers["infra-no-application"] = lambda: self.layer_reference("infra-no-application", "infrastructure", "application")
        if self.commit_files is None:
            makers.pop("churn-concentration")
        if self.model.targets is None:
            makers.pop("untested-port")
        if self.config.crate_graph == "B":
            makers.pop("domain-no-io")
        return reduce(DataFrame.unionAll, [make() for rule, make in makers.items() if not only or rule in only])

    def premises(self) -> DataFrame:
        """project and one column for each rule: null if it can be evaluated, else why not."""
        has = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
        s = self.symbols.groupBy("project").agg(
            *[has(F.col("layer") == x).alias(f"l_{x}") for x in ("domain", "application", "infrastructure")],
            has((F.col("kind") == "trait") & (F.col("pattern") == "port")).alias("port"),
            has(F.expr(USE_CASE_DIR)).alias("use_case_dir"), has(F.col("pattern") == "converter").alias("converter"),
            has(F.col("pattern").isin(*CONCRETE) & (F.col("kind") == "method")).alias("store_method"),
            has(F.col("pattern") == "command-handler").alias("handler"), has((F.col("pattern") == "service") & F.col("kind").isin("fn", "method")).alias("service"), has(F.expr(RENDERS)).alias("render"),
        )
        seam = self.config.flow.index("port") if "port" in self.config.flow else None
        station = self._station("pattern")
        labels = self.labels.groupBy("project").agg(
            has(F.col("pattern").isin(*CONCRETE) & ~F.col("inherited")).alias("concrete"), has(F.col("pattern").isin(*LEVELS)).alias("level"),
            has(station < (seam or 0)).alias("above"), has(station > (99 if seam is None else seam)).alias("below"),
        )
        pair = self.where.where("not inherited").join(last_by_id(self.model.symbols).select("project", "id", "module"), ["project", "id"]).groupBy("project", "module").agg(F.count("*").alias("n"))
        pair = pair.groupBy("project").agg((F.max("n") >= 2).alias("pair"))
        out = s.join(labels, "project", "left").join(pair, "project", "left")
        if self.model.targets is not None:
            out = out.join(self.model.targets.where("kind = 'test'").groupBy("project").agg(F.count("*").alias("tests")), "project", "left")
        else:
            out = out.withColumn("tests", F.lit(0))
        if self.commit_files is not None:
            out = out.join(churn_ops.availability(self.commit_files).select("project", "enough", F.col("reason")), "project", "left")
        else:
            out = out.withColumns({"enough": F.lit(False), "reason": F.lit("no history was given")})
        no = lambda flag, why: F.when(~F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False)), why)
        missing = lambda a, b: no(f"l_{a}", f"nothing belongs to {a}").when(~F.col(f"l_{b}"), f"nothing belongs to {b}")
        port = lambda: no("port", "there is no port")
        why = {
            "domain-no-io": no("l_domain", "nothing belongs to domain"),
            "domain-no-application": missing("domain", "application"), "infra-no-application": missing("infrastructure", "application"),
            "concrete-outside-root": no("concrete", "there is no store or adapter"), "call-through-port": port(),
            "flow-skip": F.lit("the flow has no port") if seam is None else no(F.col("above") & F.col("below"), "the flow has nothing on one side of the port"),
            "no-same-level": no("level", "there is no use-case, service, store or handler"), "port-signature-purity": port(),
            "dto-in-domain": no("l_domain", "nothing belongs to domain"), "use-case-verb": no("use_case_dir", "domain/use_cases/ is not there"),
            "time-injected": F.lit(None) if self.config.group("time") else F.lit("the configuration names no sources of time"),
            "converter-is-pure": no("converter", "there is no converter"), "port-has-fake": port(),
            "mixed-layer-module": no("pair", "no module has two labelled symbols"), "dependency-inversion": port(),
            "panic-in-domain": no("l_domain", "nothing belongs to domain"),
            "untested-port": port().when(F.coalesce("tests", F.lit(0)) == 0, "there is no test target"),
            "churn-concentration": F.when(~F.coalesce("enough", F.lit(False)), F.coalesce("reason", F.lit("no history was given"))),
            "store-decides": no("store_method", "no store or adapter has a method"), "handler-decides": no("handler", "there is no command-handler"),
            "service-wraps-one": no("service", "there is no service"), "fat-trait": port(), "renders-off-store": no("render", "nothing renders"),
        }
        return out.select("project", *[why.get(r.id, F.lit(None)).cast("string").alias(r.id) for r in RULES])

    def findings(self) -> DataFrame:
        """project, no, rule, tier, kind, gate, status, tone, because, n: one row for each rule (written once)."""
        return self._findings

    @cached_property
    def _findings(self) -> DataFrame:
        graph_b = self.config.crate_graph == "B"
        table = F.array(*[
            F.struct(
                F.lit(i).alias("no"), F.lit(r.id).alias("rule"), F.lit("compiler" if graph_b and r.id in ("domain-no-io", "domain-no-application", "infra-no-application") else r.tier).alias("tier"),
                F.lit(r.kind).alias("kind"), F.lit(r.gate).alias("gate"), F.col(f"`{r.id}`").alias("because"),
            ) for i, r in enumerate(RULES)
        ])
        rules = self.premises().select("project", F.explode(table).alias("r")).select("project", "r.*")
        found = self.instances().groupBy("project", "rule").agg(F.count("*").alias("n"), F.count_if(F.startswith("detail", F.lit("domain type realises"))).alias("bad"))
        out = rules.join(found, ["project", "rule"], "left")
        n = F.when(F.col("because").isNull(), F.coalesce("n", F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
        delegated = F.lit(graph_b) & (F.col("rule") == "domain-no-io") & F.col("because").isNull()
        status = (
            F.when(delegated, "delegated").when(F.col("because").isNotNull(), "unevaluable")
            .when((F.col("rule") == "dependency-inversion") & (F.coalesce("bad", F.lit(0)) == 0), "upheld").when(n > 0, "violated").otherwise("pass")
        )
        out = out.select("project", "no", "rule", "tier", "kind", "gate", status.alias("status"), F.when(delegated, "left to the build, which keeps the crates apart").otherwise(F.coalesce("because", F.lit(""))).alias("because"), n.alias("n"))
        warns = (F.col("status") == "violated") & (F.col("gate") | (F.col("rule") == "port-has-fake"))
        tone = F.when(warns, "warn").when(F.col("status").isin("violated", "unevaluable"), "note").otherwise("good")
        return cut(out.withColumn("tone", tone))

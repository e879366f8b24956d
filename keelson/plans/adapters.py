"""The logical tables, made of the star schema that queries are run and checked on.

A fixed reading of trade data as a code base: parts are symbols, in families of twenty (an enum, a
struct and a trait with their methods, functions), brands are modules, line items are edges, orders
are commits. Every row of a table counts somewhere. Every expression has its twin in sql.py.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config, Layer, Pattern
from ..operators import churn, classify, rules, wiring
from ..schema import Model
from .lineage import at_release, cut

PROJECT = "trade"

#: How the symbols made of parts are classified.
CONFIG = Config(
    layers=(Layer("application"), Layer("domain"), Layer("infrastructure"), Layer("composition-root"), Layer("test")),
    patterns=(
        Pattern("port", "domain", "domain/ports/", ("trait",)),
        Pattern("use-case", "domain", "domain/use_cases/", ("fn",), name="^(new|old|red|blue)_"),
        Pattern("service", "domain", "domain/services/", ("fn", "struct")),
        Pattern("converter", "domain", "domain/", ("fn",), name="_(ring|bolt)_"),
        Pattern("entity", "domain", "domain/", ("struct",), has_field="id"),
        Pattern("value-object", "domain", "domain/", ("struct", "enum"), derives=("Clone",), not_has_field="id"),
        Pattern("store", "infrastructure", "infra/", ("struct",), group="infra-impl", externs=("rusqlite", "serde")),
        Pattern("adapter", "infrastructure", "infra/", ("struct",), group="infra-impl", externs=("std::fs", "std::net")),
        Pattern("command-handler", "application", "application/", ("fn",), name="^(cold|hot|large)_"),
        Pattern("view-model", "application", "application/", ("struct", "enum"), name="(g|w)[a-z]+_[0-9]*[02468]"),
        Pattern("composition-root", "composition-root", "^main", ("fn",)),
    ),
    externs={"io": ("std::fs", "std::net", "rusqlite"), "render": ("ratatui",), "time": ("std::time",)},
    forbid_in_domain=("Dto",),
    flow=("command-handler", "service", "use-case", "port", "store"),
)

#: Directory of a brand, by its number modulo 6.
DIRECTORIES = ("domain/ports/", "domain/use_cases/", "infra/", "application/", "domain/services/", "domain/")
#: Extern path that an order's priority stands for.
PATHS = {"1-URGENT": "std::fs::read", "2-HIGH": "rusqlite::Connection", "3-MEDIUM": "ratatui::Frame", "4-NOT SPECIFIED": "serde::Serialize", "5-LOW": "std::time::Instant"}
STATICS = ("mut u32", "Mutex<u8>", "OnceLock<String>", "u32")


#: Parts of a family, and which places in it are a struct's methods, a trait's, and (in every third family) more of these.
FAMILY, OF_STRUCT, OF_TRAIT, OF_WIDE_TRAIT = 20, (2, 5), (7, 8), (7, 19)

_held: dict[tuple[str, str], Trade] = {}


def trade(spark: SparkSession, sf_dir: str) -> Trade:
    """The tables over one directory: made, and written, once in a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _held:
        _held[key] = Trade(spark, sf_dir)
        at_release(lambda: _held.pop(key, None))
    return _held[key]


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _within(place: Column, ends: tuple[int, int]) -> Column:
    return place.between(*ends)


class Trade:
    """Logical tables over one directory of Parquet files; those used again and again are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_parts(self) -> int:
        return self.table("part").count()

    @cached_property
    def parts(self) -> DataFrame:
        """n, module, name, kind, parent, id, file … of each part, without nested columns."""
        n, k, blk = F.col("n"), F.col("k"), F.col("blk")
        brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
        word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
        name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), n.cast("string"), F.when(F.col("s") % 13 == 0, "Dto").otherwise(""))
        plain = self.table("part").withColumns({"n": F.col("p_partkey"), "s": F.col("p_size")})
        plain = plain.select("n", "s", brand.alias("brand"), name.alias("name"), word(1).alias("a"), word(2).alias("b"), (n % FAMILY).alias("k"), F.floor(n / FAMILY).alias("blk"))
        at = lambda i, c: F.max(F.when(k == i, F.col(c)))
        lead = plain.groupBy("blk").agg(at(0, "brand").alias("lead"), at(0, "name").alias("enum"), at(1, "name").alias("struct"), at(6, "name").alias("trait"))
        families = -(-self.n_parts // FAMILY)
        far = lead.select(F.col("blk").alias("far"), F.col("enum").alias("far_enum"), F.col("struct").alias("far_struct"))
        after = plain.select((n - 1).alias("n"), F.col("name").alias("next"))
        both = plain.join(lead, "blk").withColumn("far", (blk * 3 + 1) % families).join(far, "far", "left").join(after, "n", "left")
        of_struct, of_trait = _within(k, OF_STRUCT), _within(k, OF_TRAIT) | (_within(k, OF_WIDE_TRAIT) & (blk % 3 == 0))
        module = F.concat(F.lit("b"), F.col("lead").cast("string"))
        parent = F.when(of_struct, F.concat_ws("::", module, "struct")).when(of_trait, F.concat_ws("::", module, "trait"))
        kind = F.when(of_struct | of_trait, "method").when(k.isin(0, 17), "enum").when(k.isin(1, 18), "struct").when(k == 6, "trait").when(k == 16, "static").otherwise("fn")
        folder = _pick(F.when(F.col("lead") % 10 == 5, blk % 6).otherwise(F.col("lead") % 6), DIRECTORIES)
        file = F.concat(F.when(F.col("lead") == 24, "main_").otherwise(folder), module, F.lit(".rs"))
        older = F.coalesce(F.when(F.col("s") % 3 == 0, F.col("far_enum")).otherwise(F.col("far_struct")), F.lit("none"))
        return cut(both.select(
            "n", "brand", "s", "a", "b", "name", older.alias("older"), "next", kind.alias("kind"), parent.alias("parent"), module.alias("module"),
            F.concat_ws("::", F.coalesce(parent, module), "name").alias("id"), file.alias("file"), (F.col("s") % 19 == 0).alias("is_test"),
        ))

    @cached_property
    def symbols(self) -> DataFrame:
        s, n, older = F.col("s"), F.col("n"), F.col("older")
        none = F.array().cast("array<string>")
        field = lambda name, ty: F.struct(name.alias("name"), ty.alias("ty"), F.array(ty).alias("ty_paths"))
        no_fields = F.array().cast("array<struct<name:string,ty:string,ty_paths:array<string>>>")
        named = F.array(field(F.col("a"), F.lit("u32")), field(F.when(s % 5 == 0, "id").otherwise(F.col("b")), F.lit("String")))
        numbered = F.when(s % 16 == 0, no_fields).otherwise(F.transform(F.sequence(F.lit(0), s % 16 - 1), lambda i: field(F.concat(F.lit("f"), i.cast("string")), F.lit("u8"))))
        fields = (
            F.when(F.col("kind") == "struct", F.concat(named, numbered))
            .when(F.col("kind") == "static", F.array(field(F.lit("value"), _pick(n % 4, STATICS)))).otherwise(no_fields)
        )
        is_fn, is_method = F.col("kind").isin("fn", "method"), F.col("kind") == "method"
        param = F.struct(F.lit("p").alias("name"), F.concat(F.lit("&"), older).alias("ty"), F.array(older).alias("ty_paths"), F.when(s % 4 == 2, F.array(F.lit("Port"))).otherwise(none).alias("bounds"))
        ret = F.when(s % 4 == 0, "Result<()>").when(s % 4 == 1, older)
        sig = F.struct(
            F.array(param).alias("params"), ret.alias("ret"), F.when(s % 4 == 1, F.array(older)).otherwise(none).alias("ret_paths"), none.alias("generic_bounds"),
            F.array().cast("array<struct<name:string,bounds:array<string>>>").alias("generics"), F.lit(False).alias("is_async"), is_method.alias("takes_self"), F.when(is_method, "&self").alias("receiver"),
        )
        numbers = lambda *of: [F.concat(F.lit("f"), (F.col(c) % m).cast("string")) for c, m in of]
        return cut(self.parts.select(
            F.lit(PROJECT).alias("project"), n.cast("bigint").alias("ord"), "id", "kind", "name", "module", "parent", "file", s.cast("int").alias("line"),
            F.when(s % 2 == 0, "public").otherwise("private").alias("vis"), none.alias("cfg"), "is_test",
            F.when(s % 3 == 0, F.array(F.lit("Clone"), F.lit("Debug"))).when(s % 3 == 1, F.array(F.lit("Debug"))).otherwise(none).alias("derives"), none.alias("attrs"),
            fields.alias("fields"), F.when(is_fn, sig).alias("sig"),
            F.when(is_method, F.array_distinct(F.array("a", "b", *numbers(("s", 7), ("n", 5))))).otherwise(none).alias("self_fields"), F.when(is_method, F.array("b", *numbers(("n", 5)))).otherwise(none).alias("self_reads"),
            F.when(is_fn & (s % 3 == 0), F.array(F.concat(older, F.lit("::X")))).otherwise(none).alias("matches_on"),
            F.when(is_fn & (s % 6 == 0), F.array(F.concat("a", F.lit(".x."), "b"))).otherwise(none).alias("field_chains"), F.when(is_method & (s % 2 == 0) & F.col("next").isNotNull(), F.array("next")).otherwise(none).alias("self_calls"),
            F.when(s % 11 == 0, F.array(F.struct(F.lit("unwrap").alias("method"), s.cast("int").alias("line")))).otherwise(F.array().cast("array<struct<method:string,line:int>>")).alias("panics"),
            F.array().cast("array<struct<recv:string,method:string,line:int,ty:string,callee:string>>").alias("recv_calls"), s.cast("int").alias("loc"),
        ))

    @cached_property
    def ids(self) -> DataFrame:
        return self.parts.select("n", "id", "file", "kind", "is_test", "name")

    def _to(self) -> Column:
        """The part that a line item leads to."""
        return (F.col("l_suppkey") * 13 + F.col("l_orderkey") * 7 + F.col("l_linenumber")) % self.n_parts

    @cached_property
    def edges(self) -> DataFrame:
        """A line item of over 5 is a local edge, every other one leads out of the code base."""
        items = self.table("lineitem").withColumn("_to", self._to())
        end = lambda k, c: self.ids.select(F.col("n").alias(k), F.col("id").alias(c), *([F.col("file")] if c == "from_id" else []))
        local = items.where("l_quantity > 5").join(end("l_partkey", "from_id"), "l_partkey").join(end("_to", "to_id"), "_to")
        kind = F.when(F.col("l_tax") >= 0.08, "impl").when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", "sig").otherwise("bound")
        shared = [F.lit(PROJECT).alias("project"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), "from_id"]
        local = local.select(*shared, F.lit("local").alias("to_scope"), "to_id", F.lit(None).cast("string").alias("to_krate"), F.lit(None).cast("string").alias("to_path"), kind.alias("kind"), "file", F.col("l_linenumber").cast("int").alias("line"), F.col("l_linestatus").alias("via"))
        paths = F.element_at(F.create_map(*[F.lit(x) for pair in PATHS.items() for x in pair]), F.col("o_orderpriority"))
        out = items.where("l_quantity <= 5").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(end("l_partkey", "from_id"), "l_partkey").withColumn("to_path", paths)
        out = out.select(*shared, F.lit("extern").alias("to_scope"), F.lit(None).cast("string").alias("to_id"), F.substring_index("to_path", "::", 1).alias("to_krate"), "to_path", F.when(F.col("l_returnflag") == "R", "sig").otherwise("call").alias("kind"), "file", F.col("l_linenumber").cast("int").alias("line"), F.lit(None).cast("string").alias("via"))
        return cut(local.unionAll(out))

    @cached_property
    def impls(self) -> DataFrame:
        """A struct implements each trait that its line items lead to."""
        types = self.ids.where("kind = 'struct'").select(F.col("n").alias("l_partkey"), F.col("id").alias("type_id"), "file")
        traits = self.ids.where("kind = 'trait'").select(F.col("n").alias("_to"), F.col("id").alias("trait_id"))
        met = self.table("lineitem").withColumn("_to", self._to()).join(types, "l_partkey").join(traits, "_to")
        return cut(met.select(
            F.lit(PROJECT).alias("project"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.lit("").alias("module"), F.col("trait_id").alias("trait_path"), "trait_id", F.col("type_id").alias("type_path"), "type_id",
            "file", F.col("l_linenumber").cast("int").alias("line"), (F.col("l_linenumber") == 1).alias("is_test"), F.array(F.lit("run")).alias("methods"),
        ))

    @cached_property
    def modules(self) -> DataFrame:
        by = self.parts.groupBy("module").agg(F.min("n").alias("ord"), F.min_by("file", "n").alias("file"), F.sum("s").cast("int").alias("loc"), F.count("*").alias("symbols"))
        return by.select(F.lit(PROJECT).alias("project"), F.col("ord").cast("bigint").alias("ord"), F.col("module").alias("id"), "file", F.lit(None).cast("string").alias("parent"), "loc", "symbols")

    @cached_property
    def targets(self) -> DataFrame:
        return self.table("region").select(F.lit(PROJECT).alias("project"), F.when(F.col("r_regionkey") < 2, "lib").otherwise("test").alias("kind"), F.lower("r_name").alias("name"), F.concat(F.lower("r_name"), F.lit(".rs")).alias("file"))

    def _history(self, met: DataFrame, path: Column) -> DataFrame:
        return met.select(
            F.lit(PROJECT).alias("project"), (-F.datediff("o_orderdate", F.lit("1970-01-01")).cast("bigint") * 1000000000 + F.col("o_orderkey")).alias("ord"), F.col("o_orderkey").cast("string").alias("hash"), F.col("o_custkey").cast("string").alias("author"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), path.alias("path"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("removed"),
        )

    @cached_property
    def commit_files(self) -> DataFrame:
        """A commit for each order, that touches the brands of its line items."""
        brands = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand"))
        met = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(brands, "l_partkey")
        return cut(self._history(met, F.col("p_brand")))

    @cached_property
    def changes(self) -> DataFrame:
        """The same commits on other files: one for each line number, in a folder of the customer's."""
        met = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return self._history(met, F.concat(F.lit("m"), (F.col("o_custkey") % 40).cast("string"), F.lit("/f"), F.col("l_linenumber").cast("string")))

    @cached_property
    def change_links(self) -> DataFrame:
        """Links from the first to the second file of every other folder."""
        even = self.table("customer").select((F.col("c_custkey") % 40).alias("m")).distinct().where("m % 2 = 0")
        path = lambda i: F.concat(F.lit("m"), F.col("m").cast("string"), F.lit(f"/f{i}"))
        return even.select(F.lit(PROJECT).alias("project"), path(1).alias("a"), path(2).alias("b"))

    @staticmethod
    def _nearest(met: DataFrame, k: int) -> DataFrame:
        """Links (a, b) from each a to the k others that it meets most often."""
        n = met.where("a != b").groupBy("a", "b").agg(F.count("*").alias("n"))
        order = W.partitionBy("a").orderBy(F.desc("n"), "b")
        return cut(n.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select(F.lit(PROJECT).alias("project"), "a", "b"))

    @cached_property
    def brand_links(self) -> DataFrame:
        """Links between brands (as files): to the three that are most often sold beside a brand."""
        brand = self.table("part").select("p_partkey", "p_brand")
        met = self.table("lineitem").select("l_partkey", self._to().alias("_to"))
        met = met.join(brand.withColumnsRenamed({"p_partkey": "l_partkey", "p_brand": "a"}), "l_partkey").join(brand.withColumnsRenamed({"p_partkey": "_to", "p_brand": "b"}), "_to")
        return self._nearest(met, 3)

    @cached_property
    def brand_modules(self) -> DataFrame:
        return self.table("part").select("p_brand").distinct().select(F.lit(PROJECT).alias("project"), F.col("p_brand").alias("id"), F.col("p_brand").alias("file"))

    @cached_property
    def churn(self) -> DataFrame:
        return cut(churn.scored(churn.per_file(self.commit_files), churn.dependents(self.brand_links, self.brand_modules)))

    @cached_property
    def nation_links(self) -> DataFrame:
        """A sparse graph of nations: each customer nation to the two supplier nations it buys most from."""
        met = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        nation = self.table("nation")
        met = met.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("a")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("b")), "s_nationkey")
        return self._nearest(met, 2)

    @cached_property
    def touches(self) -> DataFrame:
        """Events as methods (users) that touch fields (keys) of a type (event type and fifteen users)."""
        kind = F.concat("event_type", F.lit("_"), F.floor(F.col("user_id") / 15).cast("string"))
        field = F.concat(F.lit("f"), F.get_json_object("props", "$.k"))
        return cut(self.table("events").select(F.lit(PROJECT).alias("project"), kind.alias("type"), F.col("user_id").alias("method"), field.alias("field")).distinct())

    @cached_property
    def model(self) -> Model:
        return Model(self.modules, self.symbols, self.edges, self.impls, None, self.targets)

    @cached_property
    def classified(self) -> classify.Classified:
        found = classify.classify(self.symbols, self.edges, self.impls, CONFIG)
        return found._replace(by_symbol=cut(found.by_symbol), unmatched=cut(found.unmatched))

    @cached_property
    def evaluation(self) -> rules.Evaluation:
        return rules.Evaluation(self.model, self.classified, CONFIG, self.commit_files, churn.dependents(self.brand_links, self.brand_modules))

    @cached_property
    def findings(self) -> DataFrame:
        return self.evaluation.findings()

    @cached_property
    def wiring(self) -> wiring.Wiring:
        return wiring.Wiring(self.model, self.classified, CONFIG)

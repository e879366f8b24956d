"""The catalogue: one query for each operator, with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import functions as fn
from ..operators import assertions, churn, classify, cochange, cohesion, graph, impact, links, ratchet, resolve, rules, views, wiring
from ..sources import crates, gitlog
from ..streaming import watch
from . import families, sql
from .adapters import CONFIG, PROJECT, Trade, trade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*names: str, sql_body: str | None = None, raw: bool = False):
    """Registers a function of Trade; names are the expressions that its SQL needs."""

    def register(f: Callable[[Trade], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(trade(spark, sf_dir)).drop("project")
        if sql_body is not None:
            ORACLES[f.__name__] = sql_body if raw else sql.with_ctes(sql_body, *names)
        return f

    return register


# ---------------------------------------------------------------- churn


@query("churn", sql_body="SELECT path, commits, added, removed, first, last, authors FROM churn")
def churn_per_file(t: Trade) -> DataFrame:
    return churn.per_file(t.commit_files)


@query("commits", sql_body="SELECT min(date) AS since, count(DISTINCT hash) AS commits, count(DISTINCT path) AS files FROM commits")
def churn_window(t: Trade) -> DataFrame:
    return churn.window(t.commit_files)


@query("commits", sql_body="SELECT true AS available, count(DISTINCT hash) >= 20 AS enough, CASE WHEN count(DISTINCT hash) >= 20 THEN '' ELSE count(DISTINCT hash) || ' of 20 commits that a ranking needs' END AS reason FROM commits")
def churn_availability(t: Trade) -> DataFrame:
    return churn.availability(t.commit_files)


@query("churn", sql_body="SELECT path, commits, deps, score FROM churn")
def dependents_score(t: Trade) -> DataFrame:
    return t.churn.select("project", "path", "commits", "deps", "score")


@query("churn", sql_body="SELECT path, commits, deps, score FROM (SELECT *, max(commits) OVER () AS mc, sum(commits) OVER () AS total, count(*) OVER () AS n FROM churn) WHERE commits * 10 >= mc AND commits * n > total")
def churn_hotspots(t: Trade) -> DataFrame:
    return churn.hotspots(t.churn).select("project", "path", "commits", "deps", "score")


@query("churn", sql_body="SELECT path, deps FROM (SELECT *, max(deps) OVER () AS m FROM churn) WHERE m > 0 AND deps * 10 >= m")
def depended_upon(t: Trade) -> DataFrame:
    return churn.depended_upon(t.churn).select("project", "path", "deps")


@query("churn", sql_body="SELECT path, score FROM (SELECT *, max(score) OVER () AS m FROM churn) WHERE m > 0 AND score * 2 >= m")
def top_fraction(t: Trade) -> DataFrame:
    return churn.top_fraction(t.churn, 2).select("project", "path", "score")


@query("churn", sql_body="SELECT path, commits, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, path)::INTEGER AS rank FROM churn WHERE contains(lower(path), 'brand#1')) WHERE rank <= 40")
def hotspots_search_top(t: Trade) -> DataFrame:
    return churn.ranked(churn.search(t.churn, "BRAND#1"), "score").select("project", "path", "commits", "score", "rank")


# ---------------------------------------------------------------- links, resolution

_FILE_LINKS = "SELECT DISTINCT f.module AS a, t.module AS b FROM edges JOIN sym f ON f.id = from_id JOIN sym t ON t.id = to_id WHERE to_scope = 'local' AND f.module <> t.module"


@query("edges", sql_body=_FILE_LINKS)
def module_links(t: Trade) -> DataFrame:
    return links.file_links(t.edges, t.symbols)


@query("edges", sql_body="SELECT CASE WHEN starts_with(to_path, 'std::') THEN 'std::' || split_part(to_path, '::', 2) ELSE to_krate END AS key, count(*) AS refs FROM edges WHERE to_scope = 'extern' GROUP BY 1")
def extern_rollup(t: Trade) -> DataFrame:
    return links.extern_rollup(t.edges)


@query("sym", "modules", "edges", sql_body="SELECT (SELECT count(DISTINCT file) FROM modules) AS files, (SELECT count(*) FROM modules) AS modules, (SELECT sum(s) FROM sym)::BIGINT AS loc, (SELECT count(*) FROM sym) AS symbols, (SELECT count(*) FROM sym WHERE kind IN ('struct', 'enum', 'trait')) AS types, (SELECT count(*) FROM sym WHERE kind IN ('fn', 'method')) AS fns, (SELECT count(*) FROM edges) AS edges")
def scan_stats(t: Trade) -> DataFrame:
    return links.stats(t.symbols, t.modules, t.edges)


@query(raw=True, sql_body="SELECT l_partkey, arg_min(l_orderkey, (l_orderkey, l_linenumber, l_suppkey)) AS first_order, arg_max(l_orderkey, (l_orderkey, l_linenumber, l_suppkey)) AS last_order FROM lineitem GROUP BY l_partkey")
def first_and_last_by_id(t: Trade) -> DataFrame:
    rows = t.table("lineitem").select(F.lit(PROJECT).alias("project"), F.col("l_partkey").alias("id"), "l_orderkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("ord"))
    first = links.first_by_id(rows).select("project", F.col("id").alias("l_partkey"), F.col("l_orderkey").alias("first_order"))
    return first.join(links.last_by_id(rows).select("project", F.col("id").alias("l_partkey"), F.col("l_orderkey").alias("last_order")), ["project", "l_partkey"])


_URLS = r"""SELECT page_id, array_to_string(list_concat(list_reverse(string_split(split_part(split_part(regexp_extract(url, '://([^?#]*)', 1), '/', 1), '?', 1), '.')), list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')), '::') AS path FROM pages"""
_INDEX = "SELECT unnest(['com::example', 'com::example::tionble::en', 'net::example::tionsh', 'org']) AS id"


def _paths(t: Trade) -> DataFrame:
    host = F.reverse(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\."))
    rest = F.filter(F.split(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    return t.table("pages").select(F.lit(PROJECT).alias("project"), "page_id", F.array_join(F.concat(host, rest), "::").alias("path"))


def _known(t: Trade) -> DataFrame:
    return t.spark.range(1).select(F.lit(PROJECT).alias("project"), F.explode(F.array(*map(F.lit, ("com::example", "com::example::tionble::en", "net::example::tionsh", "org")))).alias("id"))


@query(raw=True, sql_body=f"WITH p AS ({_URLS}), i AS ({_INDEX}) SELECT page_id, path, (SELECT arg_max(id, length(id)) FROM i WHERE p.path = i.id OR starts_with(p.path, i.id || '::')) AS hit FROM p")
def longest_prefix_lookup(t: Trade) -> DataFrame:
    return resolve.longest_prefix(_paths(t), _known(t))


@query(raw=True, sql_body=f"WITH p AS ({_URLS}), i AS ({_INDEX}) SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM i WHERE p.path = i.id OR starts_with(p.path, i.id || '::')) THEN 'local' WHEN starts_with(path, 'net::') THEN 'extern' WHEN contains(path, '::') THEN 'unresolved' ELSE 'none' END AS outcome FROM p) GROUP BY outcome")
def url_resolution(t: Trade) -> DataFrame:
    crates = t.spark.range(1).select(F.lit(PROJECT).alias("project"), F.lit("trade").alias("self_crate"), F.array(F.lit("net")).alias("externs"))
    none = t.spark.createDataFrame([], "project string, ord bigint, module string, alias string, path string, base string")
    raw = _paths(t).select("project", F.lit("").alias("module"), F.col("path").alias("raw"))
    found = resolve.outcomes(resolve.resolve_paths(raw, resolve.Scope(_known(t), _known(t), none, none, crates)))
    return found.groupBy("project", "outcome").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- the scanner, on a crate for each family


def _scan_query(table: str) -> None:
    def run(t: Trade) -> DataFrame:
        """One table of a scan of all families, against what was written out by hand."""
        if not hasattr(t, "scanned"):
            t.scanned = crates.scan(families.files(t))
        return families.found(t.scanned, table).withColumnRenamed("project", "family")

    run.__name__ = f"scan_{table}"
    query("plain", sql_body=families.expected_sql(table))(run)


for _table in families.EXPECTED:
    _scan_query(_table)


# ---------------------------------------------------------------- classification


@query("labels", sql_body="SELECT id, pattern, layer, inherited, ambiguous FROM labels")
def classify_symbols(t: Trade) -> DataFrame:
    return t.classified.by_symbol


@query("own", sql_body="SELECT id, pattern FROM own WHERE ambiguous")
def classify_ambiguous_groups(t: Trade) -> DataFrame:
    return t.classified.by_symbol.where("ambiguous").select("project", "id", "pattern")


@query("labels", sql_body="SELECT id, pattern FROM labels WHERE inherited")
def inherit_labels(t: Trade) -> DataFrame:
    return t.classified.by_symbol.where("inherited").select("project", "id", "pattern")


@query("sym", "own", sql_body="SELECT c AS classified, t AS total, p AS ports, c::DOUBLE / t AS ratio FROM (SELECT (SELECT count(*) FROM own) AS c, (SELECT count(*) FROM sym WHERE parent IS NULL) AS t, (SELECT count(*) FROM sym WHERE kind = 'trait' AND starts_with(file, 'domain/ports/')) AS p)")
def coverage(t: Trade) -> DataFrame:
    return classify.coverage(t.symbols, t.classified)


@query("own", sql_body="SELECT pattern, NULL AS layer, count(*) AS n FROM own GROUP BY pattern UNION ALL SELECT NULL, layer, count(*) FROM own GROUP BY layer")
def coverage_by_pattern_layer(t: Trade) -> DataFrame:
    return classify.coverage_by_label(t.classified)


@query("sym", "own", sql_body="SELECT file, count(*) AS n, arg_min(file || ':' || line || ' ' || name, ord) AS example FROM sym WHERE parent IS NULL AND id NOT IN (SELECT id FROM own) GROUP BY file")
def gaps(t: Trade) -> DataFrame:
    return classify.gaps(t.classified)


@query("placed", sql_body="SELECT module, string_agg(DISTINCT own_layer, '+' ORDER BY own_layer) AS layers FROM placed WHERE parent IS NULL AND NOT is_test AND own_layer IS NOT NULL GROUP BY module HAVING count(DISTINCT own_layer) > 1")
def mixed_layer_modules(t: Trade) -> DataFrame:
    return classify.mixed_layer_modules(t.symbols, t.classified).withColumn("layers", F.array_join("layers", "+"))


@query("reach", sql_body="SELECT id, string_agg(to_path, ',' ORDER BY to_path) AS reach FROM reach GROUP BY id")
def extern_reach(t: Trade) -> DataFrame:
    return classify.extern_reach(t.symbols, t.edges).withColumn("reach", F.array_join("reach", ","))


# ---------------------------------------------------------------- rules


def _rule_query(rule: str) -> None:
    name = "rule_" + rule.replace("-", "_")
    QUERIES[name] = lambda spark, sf_dir: trade(spark, sf_dir).evaluation.instances((rule,)).drop("project")
    ORACLES[name] = sql.rule_sql(rule)


for _r in rules.RULES:
    _rule_query(_r.id)

_NEEDED, _INSTANCES = sql.all_instances()
_UNTIL = "VALUES " + ", ".join(f"({i}, '{r.id}', '{r.tier}', '{r.kind}', {str(r.gate).lower()})" for i, r in enumerate(rules.RULES))
_NO_PORT = "CASE WHEN NOT bool_or(kind = 'trait' AND pattern = 'port') THEN 'there is no port' END"
_WHY = f"""
SELECT unnest(['call-through-port', 'port-signature-purity', 'port-has-fake', 'dependency-inversion', 'untested-port', 'fat-trait']) AS rule, {_NO_PORT} AS why FROM placed
UNION ALL SELECT unnest(['domain-no-io', 'dto-in-domain', 'panic-in-domain']), CASE WHEN NOT bool_or(layer = 'domain') THEN 'nothing belongs to domain' END FROM placed
UNION ALL SELECT 'domain-no-application', CASE WHEN NOT bool_or(layer = 'domain') THEN 'nothing belongs to domain' WHEN NOT bool_or(layer = 'application') THEN 'nothing belongs to application' END FROM placed
UNION ALL SELECT 'infra-no-application', CASE WHEN NOT bool_or(layer = 'infrastructure') THEN 'nothing belongs to infrastructure' WHEN NOT bool_or(layer = 'application') THEN 'nothing belongs to application' END FROM placed
UNION ALL SELECT 'concrete-outside-root', CASE WHEN NOT bool_or(pattern IN ('store', 'adapter', 'infra-impl') AND NOT inherited) THEN 'there is no store or adapter' END FROM placed
UNION ALL SELECT 'flow-skip', CASE WHEN NOT (bool_or(pattern IN ('command-handler', 'service', 'use-case')) AND bool_or(pattern = 'store')) THEN 'the flow has nothing on one side of the port' END FROM placed
UNION ALL SELECT 'no-same-level', CASE WHEN NOT bool_or(pattern IN ('use-case', 'service', 'store', 'command-handler')) THEN 'there is no use-case, service, store or handler' END FROM placed
UNION ALL SELECT 'use-case-verb', CASE WHEN NOT bool_or(kind = 'fn' AND contains(file, 'domain/use_cases/') AND NOT is_test) THEN 'domain/use_cases/ is not there' END FROM placed
UNION ALL SELECT 'converter-is-pure', CASE WHEN NOT bool_or(pattern = 'converter') THEN 'there is no converter' END FROM placed
UNION ALL SELECT 'mixed-layer-module', CASE WHEN NOT bool_or(n >= 2) THEN 'no module has two labelled symbols' END FROM (SELECT module, count(*) AS n FROM placed WHERE NOT inherited GROUP BY module)
UNION ALL SELECT 'store-decides', CASE WHEN NOT bool_or(pattern IN ('store', 'adapter', 'infra-impl') AND kind = 'method') THEN 'no store or adapter has a method' END FROM placed
UNION ALL SELECT 'handler-decides', CASE WHEN NOT bool_or(pattern = 'command-handler') THEN 'there is no command-handler' END FROM placed
UNION ALL SELECT 'service-wraps-one', CASE WHEN NOT bool_or(pattern = 'service' AND kind IN ('fn', 'method')) THEN 'there is no service' END FROM placed
UNION ALL SELECT 'renders-off-store', CASE WHEN NOT bool_or(pattern = 'view-model' AND kind IN ('fn', 'method') AND NOT is_test) THEN 'nothing renders' END FROM placed"""
_FINDINGS = f"""
SELECT r.*, CASE WHEN why IS NOT NULL THEN 'unevaluable' WHEN rule = 'dependency-inversion' AND coalesce(bad, 0) = 0 THEN 'upheld' WHEN coalesce(n, 0) > 0 THEN 'violated' ELSE 'pass' END AS status, coalesce(why, '') AS because, CASE WHEN why IS NULL THEN coalesce(n, 0) ELSE 0 END AS n
FROM ({_UNTIL}) r(no, rule, tier, kind, gate)
LEFT JOIN (SELECT rule, count(*) AS n, count(*) FILTER (starts_with(detail, 'domain type realises')) AS bad FROM ({_INSTANCES}) GROUP BY rule) i USING (rule)
LEFT JOIN ({_WHY}) w USING (rule)"""


@query(*dict.fromkeys([*_NEEDED, "placed"]), sql_body=f"SELECT no::INTEGER AS no, rule, tier, kind, gate, status, because, n, CASE WHEN status = 'violated' AND (gate OR rule = 'port-has-fake') THEN 'warn' WHEN status IN ('violated', 'unevaluable') THEN 'note' ELSE 'good' END AS tone FROM ({_FINDINGS})")
def findings_report(t: Trade) -> DataFrame:
    return t.findings


@query(*_NEEDED, sql_body=f"SELECT rule, from_id, to_id, file, line, detail FROM ({_INSTANCES})")
def rule_instances(t: Trade) -> DataFrame:
    return t.evaluation.instances()


_GATES = "gate AND kind = 'decidable' AND status <> 'delegated'"


@query(*dict.fromkeys([*_NEEDED, "placed"]), sql_body=f"SELECT count(*) FILTER (status = 'upheld') AS upheld, count(*) FILTER (status = 'violated') AS violated, count(*) FILTER (status = 'unevaluable') AS unevaluable, count(*) FILTER (status IN ('pass', 'delegated')) AS passing FROM ({_FINDINGS})")
def finding_counts(t: Trade) -> DataFrame:
    return ratchet.counts(t.findings)


@query(*dict.fromkeys([*_NEEDED, "placed"]), sql_body=f"SELECT coalesce(sum(greatest(n, 1)) FILTER (status = 'violated'), 0)::BIGINT AS violations, count(*) FILTER (status = 'violated' AND {_GATES}) AS gating_failures, count(*) AS rules FROM ({_FINDINGS})")
def finding_totals(t: Trade) -> DataFrame:
    return ratchet.totals(t.findings)


@query(*dict.fromkeys([*_NEEDED, "placed"]), sql_body=f"SELECT CASE WHEN NOT ({_GATES}) THEN 'advisory' WHEN tier = 'compiler' THEN 'compiler' WHEN tier = 'clippy' THEN 'clippy' ELSE 'checked-here' END AS bucket, count(*) AS n FROM ({_FINDINGS}) GROUP BY 1")
def enforcement_partition(t: Trade) -> DataFrame:
    return ratchet.enforcement(t.findings)


@query(*dict.fromkeys([*_NEEDED, "placed"]), sql_body=f"SELECT DISTINCT substr(sha1(rule || '|' || from_id || '|' || to_id), 1, 12) AS fp, rule, from_id, to_id FROM ({_INSTANCES}) WHERE rule IN (SELECT rule FROM ({_FINDINGS}) WHERE status = 'violated' AND {_GATES})")
def current_violations(t: Trade) -> DataFrame:
    return ratchet.current(t.findings, t.evaluation.instances())


@query(*dict.fromkeys([*_NEEDED, "placed"]), sql_body=f"SELECT rule, CASE WHEN kind = 'heuristic' THEN 'heuristic' ELSE 'advisory' END AS reason FROM ({_FINDINGS}) WHERE status = 'violated' AND NOT gate")
def excluded_violations(t: Trade) -> DataFrame:
    return ratchet.excluded(t.findings)


# ---------------------------------------------------------------- ratchet, on two sets of orders

_ENTRY = "substr(sha1(rule || '|' || from_id || '|'), 1, 12) AS fp, rule, from_id, '' AS to_id"
_SNAP = """SELECT DISTINCT o_orderpriority AS rule, c_mktsegment || '::c' || (o_custkey % 200) AS from_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate {}"""
_NOW, _BASE = _SNAP.format(">= '1997-01-01'"), _SNAP.format("< '1998-01-01'")
_STATE = f"""SELECT coalesce(n.fp, b.fp) AS fp, coalesce(n.rule, b.rule) AS rule, coalesce(n.from_id, b.from_id) AS from_id, '' AS to_id, coalesce(b.note, '') AS note, CASE WHEN b.fp IS NULL THEN 'new' WHEN n.fp IS NULL THEN 'fixed' ELSE 'known' END AS state
FROM (SELECT {_ENTRY} FROM ({_NOW})) n FULL JOIN (SELECT {_ENTRY}, CASE WHEN ends_with(from_id, '7') THEN 'accepted' ELSE '' END AS note FROM ({_BASE})) b USING (fp)"""


def _snapshots(t: Trade) -> tuple[DataFrame, DataFrame]:
    met = t.table("orders").join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey"))

    def entries(df: DataFrame) -> DataFrame:
        rows = df.select(F.lit(PROJECT).alias("project"), F.col("o_orderpriority").alias("rule"), F.concat("c_mktsegment", F.lit("::c"), (F.col("o_custkey") % 200).cast("string")).alias("from_id"), F.lit("").alias("to_id")).distinct()
        return rows.withColumn("fp", fn.fingerprint(F.col("rule"), F.col("from_id"), F.col("to_id")))

    base = entries(met.where("o_orderdate < '1998-01-01'")).withColumn("note", F.when(F.endswith("from_id", F.lit("7")), "accepted").otherwise(""))
    return entries(met.where("o_orderdate >= '1997-01-01'")), base


@query(raw=True, sql_body=f"SELECT {_ENTRY} FROM ({_NOW})")
def fingerprints(t: Trade) -> DataFrame:
    return _snapshots(t)[0].select("project", "fp", "rule", "from_id", "to_id")


@query(raw=True, sql_body=_STATE)
def ratchet_diff(t: Trade) -> DataFrame:
    return ratchet.diff(*_snapshots(t))


@query(raw=True, sql_body=f"SELECT fp, rule, from_id, to_id, note FROM ({_STATE}) WHERE state <> 'fixed'")
def ratchet_update(t: Trade) -> DataFrame:
    return ratchet.update(*_snapshots(t)).select("project", "fp", "rule", "from_id", "to_id", "note")


@query(raw=True, sql_body=f"SELECT fp, rule, from_id, to_id, note FROM ({_STATE}) WHERE state = 'fixed' AND note <> ''")
def notes_dropped(t: Trade) -> DataFrame:
    return ratchet.dropped_notes(*_snapshots(t)).select("project", "fp", "rule", "from_id", "to_id", "note")


@query(raw=True, sql_body=f"SELECT count(*) FILTER (state = 'new') AS new, CASE WHEN count(*) FILTER (state = 'new') > 5 THEN 1 ELSE 0 END AS exit_code FROM ({_STATE})")
def ratchet_exit_code(t: Trade) -> DataFrame:
    return ratchet.exit_codes(ratchet.diff(*_snapshots(t)), 5)


_RENAMES = f"""SELECT o.rule, o.fp AS fixed_fp, n.fp AS new_fp FROM
(SELECT *, split_part(from_id, '::', -1) AS k, row_number() OVER (PARTITION BY rule, split_part(from_id, '::', -1) ORDER BY fp) AS i FROM ({_STATE}) WHERE state = 'fixed') o
JOIN (SELECT *, split_part(from_id, '::', -1) AS k, row_number() OVER (PARTITION BY rule, split_part(from_id, '::', -1) ORDER BY fp) AS i FROM ({_STATE}) WHERE state = 'new') n USING (rule, k, i)"""


@query(raw=True, sql_body=_RENAMES)
def rename_fold(t: Trade) -> DataFrame:
    return ratchet.fold_renames(ratchet.diff(*_snapshots(t)))


_SERIES = "SELECT row_number() OVER (ORDER BY d) - 1 AS ord, d AS \"at\", n AS violations, n / 10.0::DOUBLE AS coverage FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) AS n FROM orders GROUP BY 1)"


def _series(t: Trade) -> DataFrame:
    days = t.table("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("at")).agg(F.count("*").alias("violations"))
    return days.select(F.lit(PROJECT).alias("project"), (F.row_number().over(W.orderBy("at")) - 1).cast("bigint").alias("ord"), "at", "violations", (F.col("violations") / F.lit(10.0)).alias("coverage"))


def _today(t: Trade) -> DataFrame:
    return _series(t).groupBy("project").agg(F.max("at").alias("at"), F.lit(3).cast("bigint").alias("violations"), F.lit(0.5).alias("coverage"))


@query(raw=True, sql_body=f"SELECT ord, \"at\", CASE WHEN ord = (SELECT max(ord) FROM ({_SERIES})) THEN 3 ELSE violations END::BIGINT AS violations, CASE WHEN ord = (SELECT max(ord) FROM ({_SERIES})) THEN 0.5 ELSE coverage END::DOUBLE AS coverage FROM ({_SERIES})")
def progress_series(t: Trade) -> DataFrame:
    return ratchet.progress(_series(t), _today(t))


@query(raw=True, sql_body=f"SELECT 3 - violations AS violations, 0.5::DOUBLE - coverage AS coverage FROM ({_SERIES}) ORDER BY ord DESC LIMIT 1")
def progress_delta(t: Trade) -> DataFrame:
    return ratchet.delta(_series(t), _today(t))


@query(raw=True, sql_body="SELECT o_orderkey, strftime(make_timestamp((o_orderkey * 86399 + 1234567890) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(make_timestamp((o_orderkey * 86399 + 1234567890) * 1000000), '%Y-%m-%d') AS day FROM orders")
def civil_stamps(t: Trade) -> DataFrame:
    epoch = F.col("o_orderkey") * 86399 + 1234567890
    return t.table("orders").select("o_orderkey", fn.iso_stamp(epoch).alias("stamp"), fn.civil_date(epoch).alias("day"))


# ---------------------------------------------------------------- graphs

_SPREAD = """
, walk AS (SELECT n_name AS start, n_name AS node, 0 AS depth FROM nation UNION SELECT w.start, l.b, w.depth + 1 FROM walk w JOIN nation_links l ON l.a = w.node WHERE w.depth < 6 AND (w.depth = 0 OR w.node NOT IN ('NATION_7', 'NATION_13')))
SELECT start, node, min(depth)::INTEGER AS depth, node IN ('NATION_7', 'NATION_13') AS is_port FROM walk WHERE depth > 0 GROUP BY start, node"""


@query("nation_links", sql_body=_SPREAD)
def bfs_trace(t: Trade) -> DataFrame:
    one = lambda *ids: t.table("nation").where(F.col("n_name").isin(*ids)).select(F.lit(PROJECT).alias("project"), F.col("n_name").alias("id"))
    stations = t.table("nation").select(F.lit(PROJECT).alias("project"), F.col("n_name").alias("id"))
    return graph.trace(stations, t.nation_links, stations, one("NATION_7", "NATION_13")).select("project", "start", "node", "depth", "is_port")


_BACK = """
, back AS (SELECT n_name AS node, 0 AS depth FROM nation WHERE n_nationkey % 4 = 1 UNION SELECT l.a, depth + 1 FROM back JOIN nation_links l ON l.b = back.node WHERE depth < 30)
SELECT node, min(depth)::INTEGER AS depth, min(depth) = 1 AS direct FROM back WHERE node NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 4 = 1) GROUP BY node"""


@query("nation_links", sql_body=_BACK)
def reverse_reach(t: Trade) -> DataFrame:
    changed = t.table("nation").where("n_nationkey % 4 = 1").select(F.lit(PROJECT).alias("project"), F.col("n_name").alias("id"))
    return impact.reverse_reach(changed, t.nation_links).select("project", "node", "depth", "direct")


_COMPONENTS = """
, u AS (SELECT a, b FROM nation_links UNION SELECT b, a FROM nation_links), r AS (SELECT a AS node, a AS cur FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.cur)
SELECT node, min(cur) AS root FROM r GROUP BY node"""


@query("nation_links", sql_body=_COMPONENTS)
def graph_components(t: Trade) -> DataFrame:
    return graph.components(t.nation_links)


_SURFACES = """
, walk AS (SELECT n_name AS start, n_name AS node, 0 AS depth FROM nation WHERE n_nationkey < 8 UNION SELECT w.start, l.b, w.depth + 1 FROM walk w JOIN nation_links l ON l.a = w.node WHERE w.depth < 6)
SELECT start, min(node) AS via FROM walk WHERE node IN ('NATION_3', 'NATION_9') GROUP BY start"""


@query("nation_links", sql_body=_SURFACES)
def affected_surfaces(t: Trade) -> DataFrame:
    nation = t.table("nation").select(F.lit(PROJECT).alias("project"), F.col("n_name").alias("id"), "n_nationkey")
    start = nation.where("n_nationkey < 8").select("project", "id")
    hops = graph.trace(start, t.nation_links, nation, nation.where("false"))
    return impact.affected_surfaces(hops, start, nation.where("id in ('NATION_3', 'NATION_9')"))


# ---------------------------------------------------------------- cohesion, on events


def _touched(t: Trade) -> DataFrame:
    """Events as one row for each method of a type, in the shape of cohesion.members()."""
    e = t.touches
    fields = e.groupBy("project", "type").agg(F.sort_array(F.collect_set("field")).alias("fields"))
    rows = e.groupBy("project", "type", "method").agg(F.sort_array(F.collect_set("field")).alias("touch"))
    rows = rows.join(fields, ["project", "type"]).withColumn("m", F.row_number().over(W.partitionBy("project", "type").orderBy("method")) - 1)
    none = F.array().cast("array<string>")
    return rows.select("project", F.lit(0).cast("bigint").alias("type_ord"), "type", "fields", "m", F.col("method").cast("string").alias("method"), "touch", none.alias("calls"), F.when(F.col("method") % 2 == 0, F.col("touch")).otherwise(none).alias("reads"))


_LCOM = """
, r AS (SELECT type, 'm' || method AS node, 'm' || method AS cur FROM touches UNION SELECT DISTINCT type, field, field FROM touches
  UNION SELECT r.type, r.node, CASE WHEN starts_with(r.cur, 'm') THEN t.field ELSE 'm' || t.method END FROM r JOIN touches t ON t.type = r.type AND (r.cur = 'm' || t.method OR r.cur = t.field))
SELECT type, count(DISTINCT root)::INTEGER AS lcom4 FROM (SELECT type, node, min(cur) AS root FROM r GROUP BY type, node) GROUP BY type"""


@query("touches", sql_body=_LCOM)
def lcom4_components(t: Trade) -> DataFrame:
    return cohesion.measures(_touched(t)).select("project", "type", "lcom4")


@query()
def cohesion_measures(t: Trade) -> DataFrame:
    return cohesion.measures(_touched(t)).select("project", "type", "n_fields", "n_methods", "lcom4", "lcom4_core", F.round("modularity", 9).alias("modularity"), F.size("groups").alias("n_groups"), "verdict")


@query("members", sql_body="SELECT type, m, method, array_to_string(touch, ',') AS touch, array_to_string(calls, ',') AS calls FROM members")
def type_members(t: Trade) -> DataFrame:
    join = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return cohesion.members(t.symbols).select("project", "type", F.col("m").cast("bigint").alias("m"), "method", join("touch"), join("calls"))


_CORE = """
, fields AS (SELECT id AS type, unnest(fields) AS f FROM types WHERE id IN (SELECT type FROM members)), called AS (SELECT type, unnest(calls) AS method FROM members),
live AS (SELECT * FROM members WHERE len(touch) > 0 OR len(calls) > 0 OR (type, method) IN (SELECT type, method FROM called)),
links AS (SELECT type, 'm' || method AS a, unnest(touch) AS b FROM members UNION ALL SELECT type, 'm' || method, 'm' || unnest(calls) FROM members), both_ways AS (SELECT * FROM links UNION SELECT type, b, a FROM links),
nodes AS (SELECT type, 'm' || method AS node FROM members UNION SELECT type, f FROM fields), r AS (SELECT type, node, node AS cur FROM nodes UNION SELECT r.type, r.node, l.b FROM r JOIN both_ways l ON l.type = r.type AND l.a = r.cur),
roots AS (SELECT type, node, min(cur) AS root FROM r GROUP BY type, node),
core AS (SELECT type, 'm' || method AS node FROM live UNION SELECT type, unnest(touch) FROM members)
SELECT t.type, count(DISTINCT t.root)::INTEGER AS lcom4, count(DISTINCT CASE WHEN c.node IS NOT NULL THEN t.root END)::INTEGER AS lcom4_core FROM roots t LEFT JOIN core c ON c.type = t.type AND c.node = t.node GROUP BY t.type"""


@query("members", sql_body=_CORE)
def type_components(t: Trade) -> DataFrame:
    return cohesion.measures(cohesion.members(t.symbols)).select("project", "type", "lcom4", "lcom4_core")


_IDLE = """
, d AS (SELECT id AS type, unnest(fields) AS field FROM types WHERE id IN (SELECT type FROM members)), m AS (SELECT type, unnest(touch) AS field FROM members), r AS (SELECT type, unnest(reads) AS field FROM members)
SELECT DISTINCT type, field, CASE WHEN (type, field) NOT IN (SELECT type, field FROM m) THEN 'unused' ELSE 'write-only' END AS state FROM d WHERE (type, field) NOT IN (SELECT type, field FROM m) OR (type, field) NOT IN (SELECT type, field FROM r)"""


@query("members", sql_body=_IDLE)
def type_idle_fields(t: Trade) -> DataFrame:
    return cohesion.unused_and_write_only(cohesion.members(t.symbols))


@query("touches", sql_body="SELECT type, field, 'write-only' AS state FROM touches GROUP BY type, field HAVING NOT bool_or(method % 2 = 0)")
def unused_and_write_only(t: Trade) -> DataFrame:
    return cohesion.unused_and_write_only(_touched(t))


@query("weights", sql_body="SELECT * FROM weights")
def method_projection(t: Trade) -> DataFrame:
    rows, w = _touched(t), cohesion.projection(_touched(t))
    name = lambda c: rows.select("project", "type", F.col("m").alias(c), F.col("method").cast("bigint").alias(f"n_{c}"))
    return w.join(name("a"), ["project", "type", "a"]).join(name("b"), ["project", "type", "b"]).select("project", "type", F.col("n_a").alias("a"), F.col("n_b").alias("b"), "w")


def _groups(t: Trade) -> DataFrame:
    return t.touches.select("project", "type", "method", (F.col("method") % 4).alias("grp")).distinct()


_Q = """
, m AS (SELECT type, sum(w) AS m FROM weights GROUP BY type), e AS (SELECT type, a % 4 AS c, w FROM weights UNION ALL SELECT type, b % 4, w FROM weights), d AS (SELECT type, c, sum(w) AS d FROM e GROUP BY type, c),
l AS (SELECT type, a % 4 AS c, sum(w) AS l FROM weights WHERE a % 4 = b % 4 GROUP BY type, a % 4)
SELECT type, round(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 9) AS q FROM d JOIN m USING (type) LEFT JOIN l USING (type, c) GROUP BY type"""


@query("weights", sql_body=_Q)
def modularity_q(t: Trade) -> DataFrame:
    rows, w = _touched(t), cohesion.projection(_touched(t))
    parts = rows.select("project", "type", F.col("m").alias("node"), (F.col("method").cast("bigint") % 4).alias("community"))
    per = lambda df: df.withColumn("project", F.col("type"))  # noqa: E731  one graph for each type
    return graph.modularity(per(w), per(parts)).select(F.col("project").alias("type"), F.round("q", 9).alias("q"))


@query("owners", sql_body="SELECT type, field, grp FROM owners")
def field_owner(t: Trade) -> DataFrame:
    return cohesion.field_owners(t.touches, _groups(t), ["project", "type"])


@query("owners", sql_body="SELECT type, count(*) AS \"cross\", string_agg(DISTINCT field, ',' ORDER BY field) AS shared FROM touches JOIN groups USING (type, method) JOIN owners o USING (type, field) WHERE groups.grp <> o.grp GROUP BY type")
def cross_edges(t: Trade) -> DataFrame:
    return cohesion.cross_edges(t.touches, _groups(t), ["project", "type"]).withColumn("shared", F.array_join("shared", ","))


_LABEL = """SELECT grp, CASE WHEN n >= 2 AND n * 3 >= size THEN upper(word[1]) || word[2:] END AS label FROM (SELECT p_brand AS grp, count(*) AS size FROM part GROUP BY 1)
LEFT JOIN (SELECT p_brand AS grp, split_part(p_name, ' ', 2) AS word, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, split_part(p_name, ' ', 2)) AS k FROM part GROUP BY 1, 2) w USING (grp) WHERE k = 1"""


@query(raw=True, sql_body=_LABEL)
def prefix_label(t: Trade) -> DataFrame:
    words = F.split("p_name", " ")
    fields = t.table("part").select(F.lit(PROJECT).alias("project"), F.col("p_brand").alias("grp"), F.concat(F.element_at(words, 2), F.lit("_"), F.element_at(words, 1)).alias("field"))
    return cohesion.labels(fields, ["project", "grp"])


_CONCERN = """SELECT id, count(DISTINCT c)::INTEGER AS n, string_agg(DISTINCT c, ',' ORDER BY c) AS concerns FROM (SELECT s.id, CASE WHEN to_path = 'std::fs::read' THEN 'io' WHEN to_krate = 'rusqlite' THEN 'persistence' WHEN to_krate = 'ratatui' THEN 'ui' END AS c
FROM edges JOIN sym s ON s.id = from_id WHERE to_scope = 'extern' AND s.kind IN ('fn', 'method') AND NOT is_test) WHERE c IS NOT NULL GROUP BY id HAVING count(DISTINCT c) > 1"""


@query("edges", sql_body=_CONCERN)
def mixed_concern(t: Trade) -> DataFrame:
    return cohesion.mixed_concern(t.symbols, t.edges).withColumn("concerns", F.array_join("concerns", ","))


@query("sym", sql_body="SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN s % 10 = 0 THEN 'excluded' WHEN s < 5 OR s % 7 < 3 THEN 'cohesive' WHEN s % 3 > 1 THEN 'disconnected' WHEN s >= 12 AND (s % 20) / 20.0 >= 0.3 THEN 'splittable' WHEN s >= 12 THEN 'tangled' ELSE 'cohesive' END AS verdict FROM sym) GROUP BY verdict")
def cohesion_verdict(t: Trade) -> DataFrame:
    s = F.col("line")
    verdict = cohesion.verdict(s, s % 7, s % 3, (s % 20) / F.lit(20.0), s % 10 == 0)
    return t.symbols.groupBy("project", verdict.alias("verdict")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- wiring


_VOTE = """SELECT DISTINCT brick AS id, coalesce(first_value(pattern) OVER (PARTITION BY brick ORDER BY n DESC, pattern), 'unclassified') AS pattern FROM (SELECT module || '::*' AS brick, pattern, count(*) FILTER (pattern IS NOT NULL) AS n FROM placed WHERE kind = 'fn' AND parent IS NULL AND NOT is_test GROUP BY 1, 2)"""


@query("placed", sql_body=_VOTE)
def majority_vote(t: Trade) -> DataFrame:
    return t.wiring.bricks.where("shape = 'functions'").select("project", "id", "pattern")


_BRICKS = """SELECT b.id, b.shape, least(min(s.line), any_value(b.line)) AS first_line, greatest(max(s.line + greatest(s.line, 1) - 1), any_value(b.line + greatest(b.line, 1) - 1)) AS last_line
FROM (SELECT id, kind AS shape, file, line FROM sym WHERE NOT is_test AND kind IN ('struct', 'enum', 'trait')) b LEFT JOIN owner s ON s.brick = b.id AND s.file = b.file GROUP BY b.id, b.shape"""


@query("owner", sql_body=_BRICKS)
def brick_lines(t: Trade) -> DataFrame:
    return t.wiring.bricks.where("shape != 'functions'").select("project", "id", "shape", "first_line", "last_line")


@query("bound", sql_body="SELECT trait_id, n::INTEGER AS n, bound_to FROM bound")
def bindings_unique_impl(t: Trade) -> DataFrame:
    return t.wiring.implementors.select("project", "trait_id", F.size("types").alias("n"), "bound_to")


@query("calls", "bound", sql_body='SELECT c.brick, c.from_method, c."to", c.to_method, c.line, b.bound_to FROM calls c LEFT JOIN bound b ON b.trait_id = c."to"')
def path_calls(t: Trade) -> DataFrame:
    return t.wiring.calls.select("project", "brick", "from_method", "to", "to_method", "line", "bound_to")


_GRIP = """SELECT o.brick, o.id, CASE WHEN NOT (b.shape IS NOT DISTINCT FROM 'trait' OR o.is_public) THEN NULL WHEN EXISTS (SELECT 1 FROM calls c WHERE c."to" = o.brick AND c.to_method = o.name) THEN 'brick' ELSE 'unseen' END AS grip
FROM owner o LEFT JOIN bricks b ON b.id = o.brick"""


@query("calls", sql_body=_GRIP)
def stud_grip(t: Trade) -> DataFrame:
    return t.wiring.studs.select("project", "brick", "id", "grip")


_SOCKETS = """SELECT e.from_id AS brick, CASE WHEN b.shape = 'trait' THEN 'port' ELSE 'resolved' END AS status, e.to_id AS "to", string_agg(DISTINCT via, ', ' ORDER BY via) AS prop
FROM edges e JOIN bricks o ON o.id = e.from_id AND o.shape = 'struct' JOIN bricks b ON b.id = e.to_id WHERE e.kind IN ('sig', 'bound') AND e.from_id <> e.to_id GROUP BY ALL"""


@query("edges", "bricks", sql_body=_SOCKETS)
def socket_merge(t: Trade) -> DataFrame:
    fields = F.when(F.col("kind") == "struct", F.transform(F.array(F.lit("F"), F.lit("O")), lambda x: F.struct(x.alias("name"), x.alias("ty"), F.array(x).alias("ty_paths")))).otherwise(F.col("fields"))
    model = t.model._replace(symbols=t.symbols.withColumn("fields", F.when(F.col("kind").isin("struct"), fields).otherwise(F.array().cast(t.symbols.schema["fields"].dataType))))
    return wiring.Wiring(model, t.classified, CONFIG).sockets.where("via = 'field' and status in ('port', 'resolved')").select("project", "brick", "status", "to", "prop")


_RECV = """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN method % 3 = 0 THEN 'unread' WHEN h = 0 THEN 'library' WHEN h = 1 THEN 'followed' ELSE 'ambiguous' END AS outcome
FROM (SELECT o.n AS method, coalesce(m.h, 0) AS h FROM items i JOIN owner o ON o.n = l_partkey JOIN sym t ON t.n = i.t
LEFT JOIN (SELECT brick, n, count(*) AS h FROM owner WHERE kind = 'method' GROUP BY brick, n) m ON m.brick = t.id AND m.n = i.t + 1)) GROUP BY outcome"""


@query("owner", "items", sql_body=_RECV)
def recv_call_outcomes(t: Trade) -> DataFrame:
    ids = t.parts.select("n", "id", "name")
    items = t.table("lineitem").select("l_partkey", t._to().alias("at")).withColumn("next", F.col("at") + 1)
    items = items.join(ids.select(F.col("n").alias("at"), F.col("id").alias("target")), "at").join(ids.select(F.col("n").alias("next"), F.col("name").alias("called")), "next", "left")
    declared = F.col("l_partkey") % 3 != 0
    call = F.struct(F.lit("x").alias("recv"), F.coalesce("called", F.lit("?")).alias("method"), F.lit(1).alias("line"), F.when(declared, F.col("target")).alias("ty"), F.lit(None).cast("string").alias("callee"))
    made = items.join(ids.select(F.col("n").alias("l_partkey"), F.col("id")), "l_partkey").groupBy("id").agg(F.collect_list(call).alias("made"))
    symbols = t.symbols.join(made, "id", "left").withColumn("recv_calls", F.coalesce("made", "recv_calls")).drop("made")
    calls = wiring.Wiring(t.model._replace(symbols=symbols), t.classified, CONFIG).receiver_calls
    return calls.groupBy("project", "outcome").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- views

_TIER = "CASE {} WHEN 'application' THEN 0 WHEN 'domain' THEN 1 WHEN 'infrastructure' THEN 2 WHEN 'composition-root' THEN 3 WHEN 'test' THEN 4 ELSE 5 END"
_OWN_TIER = _TIER.format("own_layer")


@query("placed", "modules", sql_body=f"SELECT m.id AS module, count(p.id) AS n, coalesce(string_agg(DISTINCT p.pattern, ',' ORDER BY p.pattern), '') AS patterns, coalesce(min({_OWN_TIER}), 5)::INTEGER AS tier FROM modules m LEFT JOIN placed p ON p.module = m.id AND p.parent IS NULL AND NOT p.is_test AND p.pattern IS NOT NULL GROUP BY m.id")
def atlas_nodes(t: Trade) -> DataFrame:
    return views.atlas_nodes(t.model, t.classified, CONFIG).withColumn("patterns", F.array_join("patterns", ","))


@query("ports", "edges", "impls", sql_body="SELECT id AS port, (SELECT count(DISTINCT from_id) FROM edges WHERE kind = 'bound' AND to_id = p.id) AS consumers, (SELECT count(*) FROM impls WHERE trait_id = p.id AND NOT is_test) AS impls, (SELECT count(*) FROM impls WHERE trait_id = p.id AND is_test) AS fakes FROM ports p")
def atlas_ports(t: Trade) -> DataFrame:
    return views.atlas_ports(t.model, t.classified)


_FLOORS = f"""SELECT module, ({_OWN_TIER})::INTEGER AS tier, 'functions' AS floor, count(*) AS n FROM placed WHERE kind = 'fn' AND parent IS NULL AND NOT is_test GROUP BY 1, 2
UNION ALL SELECT module, ({_OWN_TIER})::INTEGER, name, greatest((SELECT count(*) FROM sym m WHERE m.parent = p.id AND NOT m.is_test), 1) FROM placed p WHERE kind IN ('struct', 'enum', 'trait') AND NOT is_test"""


@query("placed", sql_body=_FLOORS)
def tower_floors(t: Trade) -> DataFrame:
    return views.city_floors(t.model, t.classified, CONFIG)


@query("placed", sql_body=f"SELECT module, sum(n)::BIGINT AS height, string_agg(DISTINCT tier, ',' ORDER BY tier) AS present, array_to_string(list_filter([0, 1, 2, 3, 4, 5], lambda x: NOT list_contains(list(tier), x)), ',') AS absent FROM ({_FLOORS}) GROUP BY module")
def towers(t: Trade) -> DataFrame:
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    out = views.city_towers(views.city_floors(t.model, t.classified, CONFIG), CONFIG)
    return out.withColumns({"present": join("present"), "absent": join("absent")})


_PLANES = f"""SELECT module, id, ({_OWN_TIER})::INTEGER AS tier, round(10 * cos(angle) + 0.6 * sqrt(k) * cos(k * (pi() * (3 - sqrt(5)))), 2) AS x, round(10 * sin(angle) + 0.6 * sqrt(k) * sin(k * (pi() * (3 - sqrt(5)))), 2) AS z
FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY ord) - 1 AS k FROM placed WHERE parent IS NULL AND NOT is_test) JOIN (SELECT module, 2 * pi() * (row_number() OVER (ORDER BY module) - 1) / count(*) OVER () AS angle FROM (SELECT DISTINCT module FROM placed WHERE parent IS NULL AND NOT is_test)) USING (module)"""


@query("placed", sql_body=_PLANES)
def layer_planes(t: Trade) -> DataFrame:
    return views.layer_nodes(t.model, t.classified, CONFIG)


@query("edges", "placed", sql_body=f"SELECT DISTINCT from_id AS a, to_id AS b, e.kind, ({_TIER.format('t.own_layer')}) < ({_TIER.format('f.own_layer')}) AS up FROM edges e JOIN placed f ON f.id = from_id JOIN placed t ON t.id = to_id WHERE to_scope = 'local' AND NOT f.is_test AND NOT t.is_test")
def layer_links(t: Trade) -> DataFrame:
    return views.layer_links(t.model, t.classified, CONFIG).drop("rule")


@query("placed", sql_body="SELECT id, CASE WHEN contains(file, 'tui') THEN 'tui' ELSE 'cli' END AS verb FROM placed WHERE kind = 'fn' AND NOT is_test AND pattern = 'command-handler'")
def traffic_entries(t: Trade) -> DataFrame:
    return views.entries(t.model, t.classified).select("project", "id", "verb")


_HOPS = """
, walk AS (SELECT id AS start, id AS node, 0 AS depth FROM placed WHERE kind = 'fn' AND NOT is_test AND pattern = 'command-handler'
  UNION SELECT w.start, e.to_id, w.depth + 1 FROM walk w JOIN edges e ON e.from_id = w.node AND to_scope = 'local' AND kind IN ('call', 'bound') JOIN labels s ON s.id = e.to_id WHERE depth < 6 AND (depth = 0 OR w.node NOT IN (SELECT id FROM labels WHERE pattern = 'port')))
SELECT start, node, min(walk.depth)::INTEGER AS depth, any_value(l.pattern) = 'port' AS is_port, any_value(l.pattern) AS pattern FROM walk JOIN labels l ON l.id = node WHERE walk.depth > 0 GROUP BY start, node"""


@query("placed", "edges", sql_body=_HOPS)
def traffic_hops(t: Trade) -> DataFrame:
    return views.traffic(t.model, t.classified).select("project", "start", "node", "depth", "is_port", "pattern")


@query("owners", sql_body="SELECT type, grp, n_rows, n_cols, coalesce(sum(n_rows) OVER w, 0)::BIGINT AS row_at, coalesce(sum(n_cols) OVER w, 0)::BIGINT AS col_at FROM (SELECT type, grp, count(*) AS n_rows FROM groups GROUP BY 1, 2) JOIN (SELECT type, grp, count(*) AS n_cols FROM owners GROUP BY 1, 2) USING (type, grp) WINDOW w AS (PARTITION BY type ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def matrix_offsets(t: Trade) -> DataFrame:
    keys = ["project", "type"]
    n_rows = _groups(t).groupBy(*keys, "grp").agg(F.count("*").alias("n_rows"))
    n_cols = cohesion.field_owners(t.touches, _groups(t), keys).groupBy(*keys, "grp").agg(F.count("*").alias("n_cols"))
    return views.matrix_offsets(n_rows.join(n_cols, [*keys, "grp"]), keys)


@query("churn", "placed", sql_body=f"SELECT c.path, c.score, coalesce(p.tier, 5)::INTEGER AS tier, p.pattern FROM (SELECT file AS path, sum(line)::BIGINT AS score FROM sym GROUP BY file) c LEFT JOIN (SELECT file AS path, min({_OWN_TIER}) AS tier, arg_min(pattern, ord) FILTER (pattern IS NOT NULL) AS pattern FROM placed WHERE parent IS NULL AND NOT is_test GROUP BY file) p USING (path)")
def hotspot_nodes(t: Trade) -> DataFrame:
    files = t.symbols.groupBy("project", F.col("file").alias("path")).agg(F.sum("line").cast("bigint").alias("score"))
    return views.hotspot_nodes(t.model, t.classified, CONFIG, files)


@query("edges", sql_body=f"SELECT module, side, other, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY module, side ORDER BY w DESC, other)::INTEGER AS rank FROM (WITH x AS (SELECT f.module AS a, t.module AS b, count(*) AS w FROM edges JOIN sym f ON f.id = from_id JOIN sym t ON t.id = to_id WHERE to_scope = 'local' AND f.module <> t.module GROUP BY 1, 2) SELECT a AS module, 'out' AS side, b AS other, w FROM x UNION ALL SELECT b, 'in', a, w FROM x))")
def atlas_neighbours(t: Trade) -> DataFrame:
    owner = lambda c, m: t.symbols.select("project", F.col("id").alias(c), F.col("module").alias(m))
    met = t.edges.where("to_scope = 'local'").join(owner("from_id", "a"), ["project", "from_id"]).join(owner("to_id", "b"), ["project", "to_id"])
    return views.neighbours(met.where("a != b").groupBy("project", "a", "b").agg(F.count("*").alias("w")))


@query(*dict.fromkeys([*_NEEDED, "placed", "own"]), sql_body=f"SELECT (SELECT count(*) FROM own) || ' of ' || (SELECT count(*) FROM sym WHERE parent IS NULL) || ' symbols classified' || (SELECT CASE count(*) WHEN 0 THEN '' WHEN 1 THEN '; 1 port' ELSE '; ' || count(*) || ' ports' END FROM sym WHERE kind = 'trait' AND starts_with(file, 'domain/ports/')) || CASE v WHEN 0 THEN '' WHEN 1 THEN '; 1 rule violated' ELSE '; ' || v || ' rules violated' END || CASE u WHEN 0 THEN '' WHEN 1 THEN '; 1 rule could not be evaluated' ELSE '; ' || u || ' rules could not be evaluated' END || '.' AS sentence FROM (SELECT count(*) FILTER (status = 'violated') AS v, count(*) FILTER (status = 'unevaluable') AS u FROM ({_FINDINGS}))")
def narration(t: Trade) -> DataFrame:
    return views.narration(t.findings, classify.coverage(t.symbols, t.classified))


@query("own", "sym", sql_body="SELECT pattern, count(*) AS n FROM own GROUP BY pattern UNION ALL SELECT 'unclassified', count(*) FROM sym WHERE parent IS NULL AND id NOT IN (SELECT id FROM own) HAVING count(*) > 0")
def atlas_shape(t: Trade) -> DataFrame:
    return views.atlas_shape(t.classified)


@query("modules", "labels", sql_body="SELECT id AS module, CASE WHEN id IN (SELECT s.module FROM sym s JOIN labels l USING (id) WHERE l.layer = 'infrastructure') THEN 'platform' ELSE 'domain' END AS side FROM modules")
def atlas_sides(t: Trade) -> DataFrame:
    return views.atlas_sides(t.model, t.classified)


_ENTRY_ROWS = "SELECT * FROM placed WHERE kind = 'fn' AND NOT is_test AND pattern = 'command-handler'"


@query("placed", sql_body=f"SELECT module, count(*) AS n FROM ({_ENTRY_ROWS}) GROUP BY module")
def city_entries(t: Trade) -> DataFrame:
    return views.city_entries(views.entries(t.model, t.classified), t.symbols)


@query(*_NEEDED, sql_body=f"SELECT s.module, rule, count(*) AS n FROM ({_INSTANCES}) i JOIN sym s ON s.id = i.from_id GROUP BY 1, 2")
def city_findings(t: Trade) -> DataFrame:
    return views.city_findings(t.evaluation.instances(), t.symbols)


@query("edges", "modules", sql_body=f"SELECT DISTINCT x.file AS a, y.file AS b FROM ({_FILE_LINKS}) l JOIN modules x ON x.id = l.a JOIN modules y ON y.id = l.b")
def hotspot_links(t: Trade) -> DataFrame:
    return views.hotspot_links(links.file_links(t.edges, t.symbols), t.modules)


@query("commits", sql_body="SELECT min(date) AS since, count(DISTINCT hash) AS commits, count(DISTINCT path) AS files, true AS available, count(DISTINCT hash) >= 20 AS enough, '' AS reason FROM commits")
def hotspot_meta(t: Trade) -> DataFrame:
    return views.hotspot_meta(t.commit_files)


_CELLS = """
SELECT t.type, t.method, t.field, r."row", c.col FROM touches t
JOIN (SELECT type, method, (row_number() OVER (PARTITION BY type ORDER BY grp, method) - 1)::INTEGER AS "row" FROM groups) r USING (type, method)
JOIN (SELECT type, field, (row_number() OVER (PARTITION BY type ORDER BY grp, field) - 1)::INTEGER AS col FROM owners) c USING (type, field)"""


@query("owners", sql_body=_CELLS)
def matrix_cells(t: Trade) -> DataFrame:
    return views.matrix_cells(t.touches, _groups(t), ["project", "type"])


_LANES = "(SELECT start, node, h.depth, CASE pattern WHEN 'command-handler' THEN 0 WHEN 'service' THEN 1 WHEN 'use-case' THEN 2 WHEN 'port' THEN 3 WHEN 'store' THEN 4 END AS lane FROM h)"
_SUBSETS = f"""
SELECT start, unnest(list_filter([CASE WHEN beyond AND NOT service THEN 'no-service' END, CASE WHEN direct THEN 'direct' END, CASE WHEN crossing THEN 'crossing' END], lambda x: x IS NOT NULL)) AS subset FROM (
SELECT start, coalesce(bool_or(lane = 1), false) AS service, coalesce(bool_or(lane > 1), false) AS beyond, coalesce(bool_or(lane > 3 AND depth = 1), false) AS direct, coalesce(bool_or(lane = 2), false) AS crossing FROM {_LANES} GROUP BY start)"""


@query("placed", "edges", sql_body=_HOPS.replace("\nSELECT start, node", "\n, h AS (SELECT start, node", 1) + ")" + _SUBSETS)
def traffic_subsets(t: Trade) -> DataFrame:
    return views.traffic_subsets(views.traffic(t.model, t.classified, named=False), CONFIG)


@query("placed", sql_body=f"SELECT id, verb FROM (SELECT id, CASE WHEN contains(file, 'tui') THEN 'tui' ELSE 'cli' END AS verb, name, module FROM ({_ENTRY_ROWS})) WHERE verb = 'cli' AND contains(lower(verb || ' ' || name || ' ' || module || ' ' || module), 'hot')")
def traffic_search(t: Trade) -> DataFrame:
    return views.traffic_filter(views.entries(t.model, t.classified), t.symbols, ("cli",), " HOT ").select("project", "id", "verb")


@query("placed", sql_body=f"SELECT id, CASE WHEN contains(file, 'tui') THEN 'tui' ELSE 'cli' END AS verb, name AS route, file, coalesce(parent, module) AS owner FROM ({_ENTRY_ROWS})")
def endpoints(t: Trade) -> DataFrame:
    return views.endpoints(views.entries(t.model, t.classified), t.symbols)


_SLOTS = f"""
, f AS MATERIALIZED ({_FINDINGS}), cov AS (SELECT (SELECT count(*) FROM own) AS c, (SELECT count(*) FROM sym WHERE parent IS NULL) AS t, (SELECT count(*) FROM sym WHERE kind = 'trait' AND starts_with(file, 'domain/ports/')) AS p),
made AS (SELECT count(*) FILTER (NOT fake) AS real, count(*) FILTER (fake) AS fake FROM (SELECT is_test OR ends_with(file, 'mem.rs') AS fake FROM impls)),
e AS (SELECT count(*) FILTER (b = 'compiler') AS compiler, count(*) FILTER (b = 'checked-here') AS here, count(*) FILTER (b = 'clippy') AS clippy, count(*) FILTER (b = 'advisory') AS advisory FROM (SELECT CASE WHEN NOT ({_GATES}) THEN 'advisory' WHEN tier = 'compiler' THEN 'compiler' WHEN tier = 'clippy' THEN 'clippy' ELSE 'checked-here' END AS b FROM f))
SELECT 'coverage' AS slot, CASE WHEN c = t THEN 'All of ' || t || ' symbols have a label.' ELSE c || ' of ' || t || ' symbols (' || format('{{:.1f}}', 100.0 * c / t) || ' %) have a label; ' || (t - c) || ' have none and stand outside of every layer.' END AS text FROM cov
UNION ALL SELECT 'ports', CASE WHEN p = 0 THEN 'There is no port, so nothing that is asked of ports could be decided.' ELSE p || CASE p WHEN 1 THEN ' port, ' ELSE ' ports, ' END || real || CASE real WHEN 1 THEN ' implementation and ' ELSE ' implementations and ' END || fake || CASE fake WHEN 1 THEN ' fake.' ELSE ' fakes.' END END FROM cov, made
UNION ALL SELECT 'enforcement', 'Of the rules the compiler holds ' || compiler || ', this check ' || here || ', clippy ' || clippy || '; ' || advisory || ' advise.' FROM e
UNION ALL SELECT 'unevaluable', k || CASE k WHEN 1 THEN ' rule' ELSE ' rules' END || ' could not be evaluated: ' || ids || '.' FROM (SELECT count(*) AS k, string_agg(rule, ', ' ORDER BY no) AS ids FROM f WHERE status = 'unevaluable' HAVING count(*) > 0)
UNION ALL SELECT 'layering', n || CASE n WHEN 1 THEN ' violation of ' ELSE ' violations of ' END || k || CASE k WHEN 1 THEN ' decidable rule: ' ELSE ' decidable rules: ' END || ids || '.' FROM (SELECT count(*) AS k, sum(n) AS n, string_agg(rule, ', ' ORDER BY no) AS ids FROM f WHERE status = 'violated' AND kind = 'decidable' HAVING count(*) > 0)
UNION ALL SELECT 'heuristics', k || CASE k WHEN 1 THEN ' heuristic' ELSE ' heuristics' END || ' fired, which gate nothing: ' || ids || '.' FROM (SELECT count(*) AS k, string_agg(rule, ', ' ORDER BY no) AS ids FROM f WHERE status = 'violated' AND kind = 'heuristic' HAVING count(*) > 0)
UNION ALL SELECT 'baseline', '0 known, ' || n || ' new, 0 fixed against what was accepted.' FROM (SELECT count(DISTINCT rule || '|' || from_id || '|' || to_id) AS n FROM ({_INSTANCES}) WHERE rule IN (SELECT rule FROM f WHERE status = 'violated' AND {_GATES}) HAVING count(*) > 0)"""


@query(*dict.fromkeys([*_NEEDED, "placed", "own", "impls"]), sql_body=_SLOTS)
def narration_slots(t: Trade) -> DataFrame:
    now = ratchet.current(t.findings, t.evaluation.instances())
    state = ratchet.diff(now, now.limit(0).withColumn("note", F.lit("")))
    return views.narration_slots(t.findings, classify.coverage(t.symbols, t.classified), t.impls, ratchet.enforcement(t.findings), state)


# ---------------------------------------------------------------- co-change and risk

_PAIRS = """
, f AS (SELECT DISTINCT hash, path FROM changes), ok AS (SELECT * FROM f WHERE hash IN (SELECT hash FROM f GROUP BY hash HAVING count(*) <= 25)), n AS (SELECT path, count(*) AS n FROM ok GROUP BY path HAVING count(*) >= 5),
p AS (SELECT x.path AS a, y.path AS b, count(*) AS together FROM ok x JOIN ok y ON x.hash = y.hash AND x.path < y.path GROUP BY 1, 2),
pairs AS (SELECT a, b, together, together::DOUBLE / (na.n + nb.n - together) AS degree, together::DOUBLE / na.n AS a_to_b, together::DOUBLE / nb.n AS b_to_a FROM p JOIN n na ON na.path = a JOIN n nb ON nb.path = b WHERE together::DOUBLE / (na.n + nb.n - together) >= 0.3)
"""


@query("changes", sql_body=_PAIRS + "SELECT * FROM pairs")
def cochange_pairs(t: Trade) -> DataFrame:
    return cochange.pairs(t.changes)


@query("changes", sql_body="SELECT count(*) AS commits, count(*) FILTER (n > 5) AS excluded FROM (SELECT hash, count(DISTINCT path) AS n FROM changes GROUP BY hash)")
def cochange_excluded(t: Trade) -> DataFrame:
    return cochange.excluded_commits(t.changes, 5)


@query("changes", "change_links", sql_body=_PAIRS + "SELECT a, b, together FROM pairs WHERE NOT EXISTS (SELECT 1 FROM change_links l WHERE (l.a = pairs.a AND l.b = pairs.b) OR (l.a = pairs.b AND l.b = pairs.a))")
def unexplained_coupling(t: Trade) -> DataFrame:
    return cochange.unexplained(cochange.pairs(t.changes), t.change_links).select("project", "a", "b", "together")


_CROSS = _PAIRS + "SELECT a, b, split_part(a, '/', 1) <> split_part(b, '/', 1) AS cross_module FROM pairs WHERE NOT EXISTS (SELECT 1 FROM change_links l WHERE (l.a = pairs.a AND l.b = pairs.b) OR (l.a = pairs.b AND l.b = pairs.a))"


@query("changes", "change_links", sql_body=_CROSS)
def coupling_across_modules(t: Trade) -> DataFrame:
    places = t.changes.select("project", "path", F.substring_index("path", "/", 1).alias("module")).distinct()
    return cochange.unexplained(cochange.pairs(t.changes), t.change_links, places).select("project", "a", "b", "cross_module")


@query("changes", "change_links", sql_body=_PAIRS + "SELECT CASE WHEN count(*) > 0 THEN 'violated' ELSE 'pass' END AS status, '' AS because, count(*) AS n FROM pairs WHERE NOT EXISTS (SELECT 1 FROM change_links l WHERE (l.a = pairs.a AND l.b = pairs.b) OR (l.a = pairs.b AND l.b = pairs.a))")
def coupling_status(t: Trade) -> DataFrame:
    return cochange.status(t.changes, t.change_links)


@query(raw=True, sql_body=f"SELECT count(*) FILTER (state = 'new' AND rule IN ('1-URGENT', '5-LOW')) AS n FROM ({_STATE})")
def gating_new(t: Trade) -> DataFrame:
    return assertions.gating_new(ratchet.diff(*_snapshots(t)), ("1-URGENT", "5-LOW"))


@query(raw=True, sql_body="SELECT page_id, replace(url, '+', ' ') || ' x%zz y' AS text FROM pages WHERE url IS NOT NULL")
def percent_decoding(t: Trade) -> DataFrame:
    """URLs written with escapes, and read back."""
    written = F.concat(F.replace(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit(":"), F.lit("%3a")), F.lit("+x%zz%20y"))
    return t.table("pages").where("url is not null").select(F.lit(PROJECT).alias("project"), "page_id", fn.percent_decoded(written).alias("text"))


_MATRIX = "SELECT least(x, y) AS ma, greatest(x, y) AS mb, count(*) AS pairs, sum(together)::BIGINT AS together FROM (SELECT right(a, 1) AS x, right(b, 1) AS y, together FROM pairs) GROUP BY 1, 2"


@query("changes", sql_body=_PAIRS + _MATRIX)
def design_matrix(t: Trade) -> DataFrame:
    return cochange.design_matrix(cochange.pairs(t.changes), t.changes.select("project", "path", F.expr("right(path, 1)").alias("module")).distinct())


_RISK = _PAIRS + """, ch AS (SELECT unnest(['m0/f1', 'm1/f2', 'm3/f4']) AS path), pr AS (SELECT a AS path, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs),
r AS (SELECT path, row_number() OVER (ORDER BY count(*) DESC, path)::INTEGER AS rank FROM changes GROUP BY path)
SELECT ch.path, r.rank, coalesce((SELECT string_agg(DISTINCT other, ',' ORDER BY other) FROM pr WHERE pr.path = ch.path AND other NOT IN (SELECT path FROM ch)), '') AS missing, ch.path = 'm1/f2' AS tested
FROM ch LEFT JOIN r ON r.path = ch.path AND r.rank <= 40"""


@query("changes", sql_body=_RISK)
def risk_crossings(t: Trade) -> DataFrame:
    files = lambda *ps: t.spark.range(1).select(F.lit(PROJECT).alias("project"), F.explode(F.array(*map(F.lit, ps))).alias("path"))
    ranks = churn.ranked(churn.per_file(t.changes), "commits")
    out = impact.risk_crossings(files("m0/f1", "m1/f2", "m3/f4"), ranks, cochange.pairs(t.changes), files("m1/f2"))
    return out.withColumn("missing", F.array_join("missing", ","))


_ATTRIBUTED = f"SELECT fp, state, CASE WHEN ends_with(from_id, '3') THEN 'changed-code' ELSE 'scan-difference' END AS cause FROM ({_STATE}) WHERE state <> 'known'"


@query(raw=True, sql_body=_ATTRIBUTED)
def delta_attribution(t: Trade) -> DataFrame:
    now, base = _snapshots(t)
    state = ratchet.diff(now, base)
    place = lambda df: df.select("project", "rule", "from_id", "to_id", F.expr("right(from_id, 1)").alias("file"), F.lit(1).alias("line"), F.lit("").alias("detail"))
    changed = t.spark.range(1).select(F.lit(PROJECT).alias("project"), F.lit("3").alias("path"))
    return ratchet.attributed(state, changed, place(now).unionByName(place(base)).distinct()).select("project", "fp", "state", "cause")


# ---------------------------------------------------------------- streams, in batch form

_ISLANDS = """SELECT user_id, batch, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, batch"""


@query(raw=True, sql_body=_ISLANDS.replace("user_id, batch, min", "user_id, batch::BIGINT AS batch, min"))
def debounce_batches(t: Trade) -> DataFrame:
    events = t.table("events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("ord"))
    return watch.quiet_batches(events, 8 * 3600).withColumnRenamed("key", "user_id")


_LAST_GOOD = """SELECT user_id, event_id, seq::BIGINT AS seq, version::BIGINT AS version, failed FROM (SELECT user_id, event_id, row_number() OVER w AS seq, count(*) FILTER (event_type <> 'error') OVER w AS version, event_type = 'error' AS failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(raw=True, sql_body=_LAST_GOOD)
def last_good_version(t: Trade) -> DataFrame:
    events = t.table("events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("ord"), "event_id", F.when(F.col("event_type") == "error", "failed").alias("error"))
    out = watch.versions(events)
    return out.select(F.col("key").alias("user_id"), "event_id", "seq", "version", F.col("error").isNotNull().alias("failed"))


@query(raw=True, sql_body="SELECT doc_id, replace(replace(text, '</', '<\\u002F'), '<!', '<\\u0021') AS safe, upper(lang[1]) || lang[2:] AS lang FROM documents")
def script_escape(t: Trade) -> DataFrame:
    return t.table("documents").select("doc_id", fn.escape_for_script(F.col("text")).alias("safe"), fn.capitalise(F.col("lang")).alias("lang"))


@query(raw=True, sql_body="SELECT item_id, list_filter(list_distinct(c), lambda x: NOT list_bool_or(list_transform(c, lambda y: length(y) > length(x) AND ends_with(y, '.' || x)))).list_sort().array_to_string(',') AS chains FROM (SELECT item_id, [w[1] || '.' || w[2] || '.' || w[3], w[2] || '.' || w[3], w[4]] AS c FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))")
def longest_chains(t: Trade) -> DataFrame:
    w = F.split("text", " ")
    at = lambda i: F.element_at(w, i)
    chains = F.array(F.concat_ws(".", at(1), at(2), at(3)), F.concat_ws(".", at(2), at(3)), at(4))
    kept = F.array_sort(F.filter(F.array_distinct(chains), lambda c: ~F.exists(chains, lambda o: (F.length(o) > F.length(c)) & F.endswith(o, F.concat(F.lit("."), c)))))
    return t.table("benchmark").select("item_id", F.array_join(kept, ",").alias("chains"))


_LOG = """SELECT o_orderkey::VARCHAR AS hash, o_custkey::VARCHAR AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, p_brand AS path, l_quantity::BIGINT AS added,
CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END::BIGINT AS removed FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"""


@query(raw=True, sql_body=_LOG)
def git_log_records(t: Trade) -> DataFrame:
    """The log of each customer's orders as a text, cut into commits and read back."""
    c = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    header = F.concat_ws(gitlog.FIELD, F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    line = F.concat_ws("\t", F.col("l_quantity").cast("bigint").cast("string"), F.when(F.col("l_linenumber") == 1, "-").otherwise(F.col("l_linenumber").cast("string")), F.col("p_brand"))
    commit = c.groupBy("o_custkey", "o_orderkey").agg(F.concat(F.lit(gitlog.RECORD), F.first(header), F.lit("\n\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n")).alias("commit"))
    texts = commit.groupBy(F.col("o_custkey").cast("string").alias("project")).agg(F.array_join(F.collect_list("commit"), "").alias("text"))
    return gitlog.parse(gitlog.records(texts)).drop("ord")


_JSON = """SELECT id, to_json({'id': id, 'kind': kind, 'module': module, 'parent': parent, 'line': line, 'is_test': is_test,
'derives': CASE s % 3 WHEN 0 THEN ['Clone', 'Debug'] WHEN 1 THEN ['Debug'] ELSE [] END})::VARCHAR AS json FROM sym"""


@query("sym", sql_body=_JSON)
def json_export(t: Trade) -> DataFrame:
    """Rows as the JSON sink writes them."""
    row = F.struct("id", "kind", "module", "parent", "line", "is_test", "derives")
    return t.symbols.select("project", "id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))

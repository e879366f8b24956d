"""DuckDB twins of the queries: the same answers from the same tables, written independently."""

from __future__ import annotations

#: The adapters, as common table expressions. Each may use those before it.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "plain": ((), r"""
SELECT p_partkey AS n, p_partkey % 20 AS k, p_partkey // 20 AS blk, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS brand,
  replace(p_name, ' ', '_') || '_' || p_partkey || CASE WHEN p_size % 13 = 0 THEN 'Dto' ELSE '' END AS name, p_size AS s, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b
FROM part"""),
    "lead": (("plain",), r"""
SELECT blk, max(brand) FILTER (k = 0) AS lead, max(name) FILTER (k = 0) AS enum, max(name) FILTER (k = 1) AS struct, max(name) FILTER (k = 6) AS trait FROM plain GROUP BY blk"""),
    "sym": (("plain", "lead"), r"""
SELECT p.n, p.n::BIGINT AS ord, p.brand, p.s, p.a, p.b, p.name, coalesce(CASE WHEN p.s % 3 = 0 THEN far.enum ELSE far.struct END, 'none') AS older, nx.name AS next,
  'b' || l.lead AS module, p.k BETWEEN 2 AND 5 AS of_struct, p.k IN (7, 8) OR (p.k BETWEEN 7 AND 19 AND p.blk % 3 = 0) AS of_trait,
  CASE WHEN of_struct OR of_trait THEN 'method' WHEN p.k IN (0, 17) THEN 'enum' WHEN p.k IN (1, 18) THEN 'struct' WHEN p.k = 6 THEN 'trait' WHEN p.k = 16 THEN 'static' ELSE 'fn' END AS kind,
  CASE WHEN of_struct THEN 'b' || l.lead || '::' || l.struct WHEN of_trait THEN 'b' || l.lead || '::' || l.trait END AS parent,
  coalesce(parent, 'b' || l.lead) || '::' || p.name AS id,
  CASE WHEN l.lead = 24 THEN 'main_' ELSE ['domain/ports/', 'domain/use_cases/', 'infra/', 'application/', 'domain/services/', 'domain/'][CASE WHEN l.lead % 10 = 5 THEN p.blk % 6 ELSE l.lead % 6 END + 1] END || 'b' || l.lead || '.rs' AS file,
  p.s % 19 = 0 AS is_test, p.s::INTEGER AS line, p.s % 2 = 0 AS is_public,
  CASE WHEN kind IN ('fn', 'method') AND p.s % 4 = 0 THEN 'Result<()>' WHEN kind IN ('fn', 'method') AND p.s % 4 = 1 THEN older END AS ret,
  ['mut u32', 'Mutex<u8>', 'OnceLock<String>', 'u32'][p.n % 4 + 1] AS static_ty
FROM plain p JOIN lead l ON l.blk = p.blk LEFT JOIN lead far ON far.blk = (p.blk * 3 + 1) % (SELECT (count(*) + 19) // 20 FROM part) LEFT JOIN plain nx ON nx.n = p.n + 1"""),
    "items": ((), "SELECT *, (l_suppkey * 13 + l_orderkey * 7 + l_linenumber) % (SELECT count(*) FROM part) AS t FROM lineitem"),
    "edges": (("sym", "items"), r"""
SELECT l_orderkey * 8 + l_linenumber AS ord, f.id AS from_id, 'local' AS to_scope, t.id AS to_id, NULL::VARCHAR AS to_krate, NULL::VARCHAR AS to_path,
  CASE WHEN l_tax >= 0.08 THEN 'impl' WHEN l_returnflag = 'A' THEN 'call' WHEN l_returnflag = 'R' THEN 'sig' ELSE 'bound' END AS kind, f.file, l_linenumber::INTEGER AS line, l_linestatus AS via
FROM items i JOIN sym f ON f.n = l_partkey JOIN sym t ON t.n = i.t WHERE l_quantity > 5
UNION ALL
SELECT l_orderkey * 8 + l_linenumber, f.id, 'extern', NULL, split_part(x.p, '::', 1), x.p, CASE WHEN l_returnflag = 'R' THEN 'sig' ELSE 'call' END, f.file, l_linenumber::INTEGER, NULL
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN sym f ON f.n = l_partkey
JOIN (VALUES ('1-URGENT', 'std::fs::read'), ('2-HIGH', 'rusqlite::Connection'), ('3-MEDIUM', 'ratatui::Frame'), ('4-NOT SPECIFIED', 'serde::Serialize'), ('5-LOW', 'std::time::Instant')) x(o, p) ON x.o = o_orderpriority
WHERE l_quantity <= 5"""),
    "impls": (("sym", "items"), r"""
SELECT l_orderkey * 8 + l_linenumber AS ord, t.id AS trait_id, s.id AS type_id, s.file, l_linenumber::INTEGER AS line, l_linenumber = 1 AS is_test
FROM items i JOIN sym s ON s.n = l_partkey AND s.kind = 'struct' JOIN sym t ON t.n = i.t AND t.kind = 'trait'"""),
    "modules": (("sym",), "SELECT module AS id, min(ord) AS ord, arg_min(file, n) AS file FROM sym GROUP BY module"),
    "reach": (("sym", "edges"), "SELECT DISTINCT o.id, e.to_path FROM edges e JOIN (SELECT id AS from_id, id FROM sym UNION SELECT id, parent FROM sym WHERE parent IS NOT NULL) o USING (from_id) WHERE to_scope = 'extern'"),
    "patterns": ((), r"""
SELECT * FROM (VALUES (0, 'port', 'domain', NULL, NULL), (1, 'use-case', 'domain', NULL, NULL), (2, 'service', 'domain', NULL, NULL), (3, 'converter', 'domain', NULL, NULL), (4, 'entity', 'domain', NULL, NULL),
 (5, 'value-object', 'domain', NULL, NULL), (6, 'store', 'infrastructure', 'infra-impl', ['rusqlite', 'serde']), (7, 'adapter', 'infrastructure', 'infra-impl', ['std::fs', 'std::net']),
 (8, 'command-handler', 'application', NULL, NULL), (9, 'view-model', 'application', NULL, NULL), (10, 'composition-root', 'composition-root', NULL, NULL)) t(k, pattern, layer, grp, externs)"""),
    "hits": (("sym", "patterns", "reach"), r"""
SELECT s.id, s.ord, k, pattern, layer, grp, externs IS NULL OR EXISTS (SELECT 1 FROM reach r WHERE r.id = s.id AND list_bool_or(list_transform(externs, lambda x: starts_with(r.to_path, x)))) AS decided
FROM sym s JOIN patterns p ON CASE k
  WHEN 0 THEN starts_with(file, 'domain/ports/') AND kind = 'trait'
  WHEN 1 THEN starts_with(file, 'domain/use_cases/') AND kind = 'fn' AND regexp_matches(name, '^(new|old|red|blue)_')
  WHEN 2 THEN starts_with(file, 'domain/services/') AND kind IN ('fn', 'struct')
  WHEN 3 THEN starts_with(file, 'domain/') AND kind = 'fn' AND regexp_matches(name, '_(ring|bolt)_')
  WHEN 4 THEN starts_with(file, 'domain/') AND kind = 'struct' AND s % 5 = 0
  WHEN 5 THEN starts_with(file, 'domain/') AND kind IN ('struct', 'enum') AND s % 3 = 0 AND NOT (kind = 'struct' AND s % 5 = 0)
  WHEN 6 THEN starts_with(file, 'infra/') AND kind = 'struct' WHEN 7 THEN starts_with(file, 'infra/') AND kind = 'struct'
  WHEN 8 THEN starts_with(file, 'application/') AND kind = 'fn' AND regexp_matches(name, '^(cold|hot|large)_')
  WHEN 9 THEN starts_with(file, 'application/') AND kind IN ('struct', 'enum') AND regexp_matches(name, '(g|w)[a-z]+_[0-9]*[02468]')
  ELSE starts_with(file, 'main') AND kind = 'fn' END
WHERE s.parent IS NULL AND NOT s.is_test"""),
    "own": (("sym", "hits"), r"""
SELECT id, CASE WHEN nd <> 1 AND ng = n AND g0 = g1 THEN g0 WHEN nd > 0 THEN pd ELSE p0 END AS pattern, CASE WHEN nd <> 1 AND ng = n AND g0 = g1 THEN l0 WHEN nd > 0 THEN ld ELSE l0 END AS layer,
  coalesce(nd <> 1 AND ng = n AND g0 = g1, false) AS ambiguous
FROM (SELECT id, count(*) AS n, count(grp) AS ng, min(grp) AS g0, max(grp) AS g1, count(*) FILTER (decided) AS nd, arg_min(pattern, k) AS p0, arg_min(layer, k) AS l0,
        arg_min(pattern, k) FILTER (decided) AS pd, arg_min(layer, k) FILTER (decided) AS ld FROM hits GROUP BY id)
UNION ALL SELECT id, 'test', 'test', false FROM sym WHERE parent IS NULL AND is_test"""),
    "labels": (("sym", "own"), "SELECT id, pattern, layer, false AS inherited, ambiguous FROM own UNION ALL SELECT s.id, o.pattern, o.layer, true, false FROM sym s JOIN own o ON o.id = s.parent"),
    "placed": (("sym", "labels"), r"""
SELECT s.*, l.pattern, l.layer AS own_layer, l.inherited, coalesce(l.layer, CASE WHEN starts_with(file, 'domain/') THEN 'domain' WHEN starts_with(file, 'application/') THEN 'application' WHEN starts_with(file, 'infra/') THEN 'infrastructure' END) AS layer
FROM sym s LEFT JOIN labels l USING (id)"""),
    "ends": (("edges", "placed"), r"""
SELECT e.*, f.layer AS from_layer, f.pattern AS from_pattern, f.name AS from_name, t.layer AS to_layer, t.pattern AS to_pattern, t.inherited AS to_inherited
FROM edges e LEFT JOIN placed f ON f.id = e.from_id LEFT JOIN placed t ON t.id = e.to_id"""),
    "ports": (("placed",), "SELECT * FROM placed WHERE kind = 'trait' AND pattern = 'port'"),
    "flow": ((), "SELECT * FROM (VALUES ('command-handler', 0), ('service', 1), ('use-case', 2), ('port', 3), ('store', 4)) t(pattern, pos)"),
    "commits": ((), r"""
SELECT o_orderkey::VARCHAR AS hash, o_custkey::VARCHAR AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, p_brand AS path, l_quantity::BIGINT AS added, l_linenumber::BIGINT AS removed
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"""),
    "changes": ((), r"""
SELECT o_orderkey::VARCHAR AS hash, 'm' || o_custkey % 40 || '/f' || l_linenumber AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""),
    "change_links": ((), "SELECT DISTINCT 'm' || c_custkey % 40 || '/f1' AS a, 'm' || c_custkey % 40 || '/f2' AS b FROM customer WHERE c_custkey % 40 % 2 = 0"),
    "brand_links": (("items",), r"""
SELECT a, b FROM (SELECT x.p_brand AS a, y.p_brand AS b, row_number() OVER (PARTITION BY x.p_brand ORDER BY count(*) DESC, y.p_brand) AS k
FROM items i JOIN part x ON x.p_partkey = l_partkey JOIN part y ON y.p_partkey = i.t WHERE x.p_brand <> y.p_brand GROUP BY 1, 2) WHERE k <= 3"""),
    "churn": (("commits", "brand_links"), r"""
SELECT c.*, coalesce(d.deps, 0) AS deps, commits * (1 + coalesce(d.deps, 0)) AS score FROM (
  SELECT path, count(*) AS commits, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, min(date) AS first, max(date) AS last, count(DISTINCT author) AS authors FROM commits GROUP BY path) c
LEFT JOIN (SELECT b AS path, count(*) AS deps FROM brand_links GROUP BY b) d USING (path)"""),
    "nation_links": ((), r"""
SELECT a, b FROM (SELECT cn.n_name AS a, sn.n_name AS b, row_number() OVER (PARTITION BY cn.n_name ORDER BY count(*) DESC, sn.n_name) AS k
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey WHERE cn.n_name <> sn.n_name GROUP BY 1, 2) WHERE k <= 2"""),
    "touches": ((), "SELECT DISTINCT event_type || '_' || user_id // 15 AS type, user_id AS method, 'f' || (props->>'$.k') AS field FROM events"),
    "types": (("sym",), r"""
SELECT id, [a, CASE WHEN s % 5 = 0 THEN 'id' ELSE b END] || list_transform(range(0, s % 16), lambda i: 'f' || i) AS fields FROM sym WHERE kind = 'struct' AND NOT is_test"""),
    "own_methods": (("sym", "types"), r"""
SELECT m.*, t.id AS type, t.fields, (row_number() OVER (PARTITION BY t.id ORDER BY m.ord) - 1) AS m FROM types t JOIN sym m ON m.parent = t.id AND m.kind = 'method' AND NOT m.is_test"""),
    "members": (("own_methods",), r"""
SELECT type, m, name AS method, list_sort(list_filter(list_distinct([a, b, 'f' || s % 7, 'f' || n % 5]), lambda x: list_contains(fields, x))) AS touch, [b, 'f' || n % 5] AS reads,
  CASE WHEN s % 2 = 0 AND next IN (SELECT name FROM own_methods o WHERE o.type = w.type) THEN [next] ELSE [] END AS calls FROM own_methods w"""),
    "groups": (("touches",), "SELECT DISTINCT type, method, method % 4 AS grp FROM touches"),
    "weights": (("touches",), "SELECT x.type, x.method AS a, y.method AS b, count(*)::DOUBLE AS w FROM touches x JOIN touches y ON x.type = y.type AND x.field = y.field AND x.method < y.method GROUP BY ALL"),
    "owners": (("touches", "groups"), "SELECT type, field, grp FROM (SELECT type, field, grp, row_number() OVER (PARTITION BY type, field ORDER BY count(*) DESC, grp) AS k FROM touches JOIN groups USING (type, method) GROUP BY type, field, grp) WHERE k = 1"),
    "bricks": (("sym",), "SELECT id, kind AS shape FROM sym WHERE NOT is_test AND kind IN ('struct', 'enum', 'trait')"),
    "owner": (("sym", "bricks"), "SELECT s.*, s.parent AS brick FROM sym s JOIN bricks b ON b.id = s.parent WHERE s.kind = 'method' AND NOT is_test UNION ALL SELECT s.*, s.module || '::*' FROM sym s WHERE kind = 'fn' AND parent IS NULL AND NOT is_test"),
    "bound": (("impls", "bricks"), "SELECT i.trait_id, CASE WHEN count(DISTINCT type_id) = 1 THEN min(type_id) END AS bound_to, count(DISTINCT type_id) AS n FROM impls i JOIN bricks t ON t.id = i.type_id JOIN bricks r ON r.id = i.trait_id WHERE NOT is_test GROUP BY i.trait_id"),
    "calls": (("edges", "owner", "bricks"), r"""
SELECT DISTINCT o.brick, o.name AS from_method, coalesce(t.brick, b.id) AS "to", t.name AS to_method, e.line
FROM edges e JOIN owner o ON o.id = e.from_id LEFT JOIN owner t ON t.id = e.to_id LEFT JOIN bricks b ON b.id = e.to_id
WHERE e.kind = 'call' AND to_scope = 'local' AND coalesce(t.brick, b.id) <> o.brick"""),
}


def with_ctes(body: str, *names: str) -> str:
    """body behind the common table expressions it names, and those that they need."""
    order: dict[str, None] = {}

    def add(name: str) -> None:
        for below in CTES[name][0]:
            add(below)
        order[name] = None

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in order) + f"\n{body.strip()}" if order else body.strip()


def _rule(rule: str, body: str) -> str:
    return f"SELECT '{rule}' AS rule, from_id, to_id, file, line, detail FROM ({body})"


_ENUMS = "SELECT DISTINCT name AS enum FROM placed WHERE kind = 'enum' AND layer = 'domain'"

RULES = {
    "domain-no-io": (("ends",), "SELECT from_id, to_path AS to_id, file, line, from_name || ' uses ' || to_path AS detail FROM ends WHERE to_scope = 'extern' AND from_layer = 'domain' AND regexp_matches(to_path, '^(std::fs|std::net|rusqlite|ratatui)')"),
    "domain-no-application": (("ends",), "SELECT from_id, to_id, file, line, from_id || ' refers to ' || to_id AS detail FROM ends WHERE to_scope = 'local' AND kind <> 'impl' AND from_layer = 'domain' AND to_layer = 'application'"),
    "infra-no-application": (("ends",), "SELECT from_id, to_id, file, line, from_id || ' refers to ' || to_id AS detail FROM ends WHERE to_scope = 'local' AND kind <> 'impl' AND from_layer = 'infrastructure' AND to_layer = 'application'"),
    "concrete-outside-root": (("ends",), "SELECT from_id, to_id, file, line, from_id || ' depends on the concrete ' || to_id AS detail FROM ends WHERE to_scope = 'local' AND kind <> 'impl' AND to_pattern IN ('store', 'adapter', 'infra-impl') AND NOT to_inherited AND NOT coalesce(from_layer IN ('infrastructure', 'composition-root', 'test'), false)"),
    "call-through-port": (("placed",), "SELECT s.id AS from_id, min(c.id) AS to_id, s.file, s.line, 'concrete type behind `p: &' || s.older || '`' AS detail FROM placed s JOIN placed c ON c.pattern IN ('store', 'adapter', 'infra-impl') AND split_part(c.id, '::', -1) = s.older WHERE s.pattern IN ('use-case', 'service', 'command-handler') AND s.kind IN ('fn', 'method') AND s.s % 4 <> 2 GROUP BY s.id, s.file, s.line, s.older"),
    "flow-skip": (("ends", "flow"), "SELECT from_id, to_id, file, line, from_pattern || ' goes past the port to ' || to_pattern AS detail FROM ends JOIN flow f ON f.pattern = from_pattern JOIN flow t ON t.pattern = to_pattern WHERE to_scope = 'local' AND kind <> 'impl' AND f.pos < 3 AND t.pos > 3"),
    "no-same-level": (("ends",), "SELECT from_id, to_id, file, line, 'one ' || from_pattern || ' calls another' AS detail FROM ends WHERE to_scope = 'local' AND kind = 'call' AND from_id <> to_id AND from_pattern = to_pattern AND from_pattern IN ('use-case', 'service', 'store', 'command-handler')"),
    "port-signature-purity": (("ports", "edges"), "SELECT s.id AS from_id, to_path AS to_id, s.file, s.line, '`' || s.name || '` has ' || to_path || ' in its signature' AS detail FROM ports p JOIN sym s ON s.parent = p.id JOIN edges e ON e.from_id = s.id AND e.kind = 'sig' AND to_scope = 'extern' WHERE NOT starts_with(to_path, 'std::')"),
    "no-global-mut": (("sym",), "SELECT id AS from_id, '' AS to_id, file, line, name || ' is a ' || CASE WHEN static_ty = 'mut u32' THEN 'static mut' WHEN static_ty = 'Mutex<u8>' THEN 'static with a Mutex' ELSE 'static with a OnceLock' END || ' (`' || static_ty || '`)' AS detail FROM sym WHERE kind = 'static' AND NOT is_test AND static_ty <> 'u32'"),
    "dto-in-domain": (("placed",), "SELECT id AS from_id, '' AS to_id, file, line, '`' || name || '` carries a transport suffix' AS detail FROM placed WHERE layer = 'domain' AND ends_with(name, 'Dto')"),
    "use-case-verb": (("placed",), "SELECT id AS from_id, '' AS to_id, file, line, '`' || name || '` starts with none of the verbs' AS detail FROM placed WHERE kind = 'fn' AND NOT is_test AND contains(file, 'domain/use_cases/') AND pattern IS DISTINCT FROM 'use-case'"),
    "time-injected": (("ends",), "SELECT from_id, to_path AS to_id, file, line, from_id || ' asks ' || to_path || ' for the time' AS detail FROM ends WHERE to_scope = 'extern' AND starts_with(to_path, 'std::time') AND NOT coalesce(from_layer IN ('infrastructure', 'test'), false)"),
    "converter-is-pure": (("placed", "edges"), r"""
SELECT id AS from_id, '' AS to_id, file, line, '`' || name || '` is given a port' AS detail FROM placed WHERE pattern = 'converter' AND s % 4 = 2
UNION ALL SELECT id, '', file, line, '`' || name || '` may fail' FROM placed WHERE pattern = 'converter' AND s % 4 = 0
UNION ALL SELECT id, '', file, line, '`' || name || '` does I/O' FROM placed WHERE pattern = 'converter' AND id IN (SELECT from_id FROM edges WHERE to_scope = 'extern' AND regexp_matches(to_path, '^(std::fs|std::net|rusqlite)'))"""),
    "port-has-fake": (("ports", "impls"), "SELECT p.id AS from_id, '' AS to_id, p.file, p.line, CASE WHEN count(i.type_id) = 0 THEN '`' || p.name || '` has no implementation' ELSE '`' || p.name || '` has ' || count(i.type_id) || ' implementation(s) and no fake among them' END AS detail FROM ports p LEFT JOIN impls i ON i.trait_id = p.id GROUP BY p.id, p.file, p.line, p.name HAVING NOT coalesce(bool_or(i.is_test OR ends_with(i.file, 'mem.rs') OR contains(i.file, '/fake')), false)"),
    "mixed-layer-module": (("placed", "modules"), "SELECT module AS from_id, '' AS to_id, any_value(m.file) AS file, 1 AS line, module || ' mixes ' || string_agg(DISTINCT own_layer, ' and ' ORDER BY own_layer) AS detail FROM placed JOIN modules m ON m.id = module WHERE parent IS NULL AND NOT is_test AND own_layer IS NOT NULL GROUP BY module HAVING count(DISTINCT own_layer) > 1"),
    "dependency-inversion": (("impls", "labels"), r"""
SELECT type_id AS from_id, trait_id AS to_id, file, line, CASE WHEN bad THEN 'domain type realises infrastructure trait ' || trait_id ELSE type_id || ' realises ' || trait_id END AS detail
FROM (SELECT i.*, t.layer = 'infrastructure' AND c.layer = 'domain' AS bad, t.layer = 'domain' AND c.layer IN ('infrastructure', 'test') AS good, bool_or(t.layer = 'infrastructure' AND c.layer = 'domain') OVER () AS any_bad
      FROM impls i LEFT JOIN labels t ON t.id = trait_id LEFT JOIN labels c ON c.id = type_id) WHERE CASE WHEN any_bad THEN bad ELSE good END"""),
    "panic-in-domain": (("placed",), "SELECT id AS from_id, 'unwrap' AS to_id, file, line, '`' || id || '` may stop at unwrap' AS detail FROM placed WHERE layer = 'domain' AND s % 11 = 0"),
    "untested-port": (("ports", "edges", "impls"), "SELECT id AS from_id, '' AS to_id, file, line, 'neither called nor realised in ' || (SELECT count(*) FROM region WHERE r_regionkey >= 2) || ' test target(s)' AS detail FROM ports WHERE id NOT IN (SELECT to_id FROM edges JOIN sym s ON s.id = from_id AND s.is_test WHERE edges.kind = 'call' AND to_scope = 'local') AND id NOT IN (SELECT trait_id FROM impls WHERE is_test)"),
    "store-decides": (("placed",), f"""
SELECT s.id AS from_id, enum AS to_id, file, line, '`' || name || '` hands back the domain enum ' || enum AS detail FROM placed s JOIN ({_ENUMS}) ON enum = s.older WHERE pattern IN ('store', 'adapter', 'infra-impl') AND kind = 'method' AND s.s % 4 = 1
UNION ALL SELECT s.id, enum, file, line, '`' || name || '` decides on ' || enum FROM placed s JOIN ({_ENUMS}) ON enum = s.older WHERE pattern IN ('store', 'adapter', 'infra-impl') AND kind = 'method' AND s.s % 3 = 0"""),
    "handler-decides": (("placed",), f"SELECT s.id AS from_id, enum AS to_id, file, line, '`' || name || '` decides on ' || enum AS detail FROM placed s JOIN ({_ENUMS}) ON enum = s.older WHERE pattern = 'command-handler' AND s.s % 3 = 0"),
    "service-wraps-one": (("ends",), "SELECT s.id AS from_id, c.to_id, s.file, s.line, '`' || s.name || '` calls a single use-case' AS detail FROM placed s JOIN (SELECT from_id, min(to_id) AS to_id FROM ends WHERE kind = 'call' AND to_scope = 'local' AND to_pattern = 'use-case' GROUP BY from_id HAVING count(*) = 1) c ON c.from_id = s.id WHERE s.pattern = 'service' AND s.kind IN ('fn', 'method')"),
    "fat-trait": (("ports",), "SELECT p.id AS from_id, '' AS to_id, p.file, p.line, '`' || p.name || '` has ' || count(*) || ' methods, more than 12' AS detail FROM ports p JOIN sym s ON s.parent = p.id GROUP BY p.id, p.file, p.line, p.name HAVING count(*) > 12"),
    "renders-off-store": (("placed",), "SELECT id AS from_id, a || '.x.' || b AS to_id, file, line, '`' || name || '` walks `' || a || '.x.' || b || '`' AS detail FROM placed WHERE kind IN ('fn', 'method') AND NOT is_test AND pattern = 'view-model' AND s % 6 = 0"),
}

CHURN_RULE = (("churn", "commits"), r"""
SELECT path AS from_id, '' AS to_id, path AS file, 1 AS line, CAST(round(100.0 * commits / total, 0) AS INTEGER) || '% of all churn; ' || deps || ' of ' || n || ' files depend on it; '
  || (SELECT count(DISTINCT hash) FROM commits) || ' commit(s) since ' || (SELECT min(date) FROM commits) AS detail
FROM (SELECT *, max(commits) OVER () AS mc, sum(commits) OVER () AS total, count(*) OVER () AS n, max(deps) OVER () AS md FROM churn)
WHERE commits * 10 >= mc AND commits * n > total AND md > 0 AND deps * 10 >= md""")


def rule_sql(rule: str) -> str:
    names, body = CHURN_RULE if rule == "churn-concentration" else RULES[rule]
    return with_ctes(_rule(rule, body), *names)


def all_instances() -> tuple[tuple[str, ...], str]:
    """Names of the expressions that are needed, and a union of all rules' instances."""
    needed = tuple(dict.fromkeys(n for names, _ in [*RULES.values(), CHURN_RULE] for n in names))
    parts = [_rule(r, body) for r, (_, body) in [*RULES.items(), ("churn-concentration", CHURN_RULE)]]
    return needed, "\nUNION ALL\n".join(parts)

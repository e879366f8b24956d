from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keelson import functions as fn
from keelson.operators import churn, cohesion, graph, ratchet
from keelson.streaming import watch


def test_scores_and_stamps(spark):
    df = spark.createDataFrame([(4, 10, 44), (1, 0, 1), (1, 3, 4), (0, 9, 0)], "c long, d long, s long")
    assert df.where(fn.churn_score(F.col("c"), F.col("d")) != F.col("s")).count() == 0
    stamps = spark.createDataFrame([(0,), (86399,), (86400,), (1709164800,), (1761234567,)], "t long").select(fn.iso_stamp(F.col("t")), fn.civil_date(F.col("t"))).collect()
    assert [tuple(r) for r in stamps] == [("1970-01-01T00:00:00Z", "1970-01-01"), ("1970-01-01T23:59:59Z", "1970-01-01"), ("1970-01-02T00:00:00Z", "1970-01-02"), ("2024-02-29T00:00:00Z", "2024-02-29"), ("2025-10-23T15:49:27Z", "2025-10-23")]


def test_stamps_of_far_years(spark):
    seconds = [(None,), (-62167219201,), (-62135596801,), (-62135596800,), (253402300799,), (253402300800,), (777591234567,), (9223372036853,)]
    stamps = spark.createDataFrame(seconds, "t long").select(fn.iso_stamp(F.col("t")), fn.civil_date(F.col("t"))).collect()
    want = [None, "-1-12-31T23:59:59Z", "0000-12-31T23:59:59Z", "0001-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "26610-11-20T13:09:27Z", "294247-01-10T04:00:53Z"]
    assert [tuple(r) for r in stamps] == [(x, x and x[:-10]) for x in want]


def test_hotspot_bounds(spark):
    rows = [("p", f"f{i}", 1, 0) for i in range(42)] + [("p", "busy", 31, 0), ("p", "leaned", 1, 6)]
    files = spark.createDataFrame(rows, "project string, path string, commits long, deps long")
    assert [r.path for r in churn.hotspots(files).collect()] == ["busy"]
    assert [r.path for r in churn.depended_upon(files).collect()] == ["leaned"]
    equal = spark.createDataFrame([("p", f"f{i}", 3, 0) for i in range(10)], "project string, path string, commits long, deps long")
    assert churn.hotspots(equal).count() == 0 and churn.depended_upon(equal).count() == 0


def test_fingerprint_of_absent_end(spark):
    import hashlib

    got = spark.range(1).select(fn.fingerprint(F.lit("r"), F.lit("f"), F.lit(None).cast("string"))).first()[0]
    assert got == hashlib.sha1(b"r|f|").hexdigest()[:12]


def one(fields, methods):
    return cohesion.one_type(fields, [m for m, *_ in methods], [t for _, t, _ in methods], [c for *_, c in methods])


def test_cohesion_is_blind_to_names():
    methods = [("a", ["x", "y"], []), ("b", ["y"], []), ("c", ["p", "q"], []), ("d", ["q"], []), ("e", [], []), ("f", [], ["e"])]
    found = one(["x", "y", "p", "q", "z"], methods)
    assert (found["lcom4"], found["lcom4_core"]) == (4, 3)
    names = {n: f"n{i}" for i, n in enumerate("zqpyxfedcba")}
    other = one([names[f] for f in ["x", "y", "p", "q", "z"]], [(names[m], [names[f] for f in t], [names[c] for c in cs]) for m, t, cs in methods])
    assert other == found


def test_greedy_communities():
    two = {(0, 1): 1.0, (0, 2): 1.0, (1, 2): 1.0, (3, 4): 1.0, (3, 5): 1.0, (4, 5): 1.0, (2, 3): 1.0}
    assert graph.greedy_communities(list(range(6)), two) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert graph.greedy_communities([1, 2], {}) == {1: 1, 2: 2}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([("p", i, i + 1) for i in range(40)] + [("p", 100, 101), ("q", 1, 7)], "project string, a long, b long")
    found = graph.components(links).groupBy("project", "root").count().collect()
    assert {(r.project, r.root, r["count"]) for r in found} == {("p", 0, 41), ("p", 100, 2), ("q", 1, 2)}


def test_trace_stops_at_ports_and_cycles(spark):
    links = spark.createDataFrame([("p", *x) for x in ("ab", "bc", "ca", "bd", "de")], "project string, a string, b string")
    nodes = spark.createDataFrame([("p", x) for x in "abcde"], "project string, id string")
    found = {(r.node, r.depth, r.is_port) for r in graph.trace(nodes.where("id = 'a'"), links, nodes, nodes.where("id = 'd'")).collect()}
    assert found == {("b", 1, False), ("c", 2, False), ("d", 2, True), ("a", 3, False)}


def test_swapping_violations_is_noticed(spark):
    entry = lambda a, note: ("p", f"fp{a}", "r", a, "", note)
    schema = "project string, fp string, rule string, from_id string, to_id string, note string"
    base = spark.createDataFrame([entry("a", "why"), entry("b", "")], schema)
    now = spark.createDataFrame([entry("a", ""), entry("c", "")], schema).drop("note")
    states = Counter(r.state for r in ratchet.diff(now, base).collect())
    assert states == {"new": 1, "known": 1, "fixed": 1}
    assert {(r.from_id, r.note) for r in ratchet.update(now, base).collect()} == {("a", "why"), ("c", "")}
    assert ratchet.exit_codes(ratchet.diff(now, base)).first().exit_code == 1


def test_progress_replaces_the_last_day_only(spark):
    series = spark.createDataFrame([("p", 0, "d1", 9, 0.1), ("p", 1, "d2", 8, 0.2)], "project string, ord long, at string, violations long, coverage double")
    today = lambda d: spark.createDataFrame([("p", d, 1, 0.9)], "project string, at string, violations long, coverage double")
    assert sorted((r.ord, r.at, r.violations) for r in ratchet.progress(series, today("d2")).collect()) == [(0, "d1", 9), (1, "d2", 1)]
    assert sorted((r.ord, r.at, r.violations) for r in ratchet.progress(series, today("d1")).collect()) == [(0, "d1", 9), (1, "d2", 8), (2, "d1", 1)]


def test_debounce_stream(spark, tmp_path):
    source = tmp_path / "polls"
    source.mkdir()
    marks = [1, 1, 1, 2, 3, 3, 3, 1]
    schema = "project string, fingerprint long, seq long"
    out, query = [], None
    stream = watch.debounce(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    query = stream.writeStream.foreachBatch(lambda df, _: out.extend(r.fingerprint for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        for k, m in enumerate(marks):
            (tmp_path / "w.json").write_text(f'{{"project": "p", "fingerprint": {m}, "seq": {k}}}\n')
            (tmp_path / "w.json").rename(source / f"{k}.json")
            query.processAllAvailable()
            time.sleep(0.05)
    finally:
        query.stop()
    assert out == [1, 3]


def test_last_good_sink(spark, tmp_path):
    def build(df):
        if df.where("v < 0").count():
            raise ValueError("broken")
        return df

    sink = watch.LastGood(spark, build, str(tmp_path / "out"), str(tmp_path / "log"))
    for k, v in enumerate([1, -1, 2]):
        sink(spark.createDataFrame([(v,)], "v long"), k)
    assert sink.state() == (3, 2) and sink.current().first().v == 2
    sink(spark.createDataFrame([(9,)], "v long"), 2)  # played again
    assert sink.state() == (3, 2) and sink.current().first().v == 2
    log = spark.read.parquet(str(tmp_path / "log")).orderBy("seq").collect()
    assert [(r.version, r.error) for r in log] == [(1, None), (1, "broken"), (2, None)]


def test_listing_fingerprint(spark):
    rows = [("p", "/a/src/x.rs", 3, 1), ("p", "/a/target/y.rs", 9, 1), ("p", "/a/readme.md", 1, 1)]
    of = lambda rs: watch.listing_fingerprint(spark.createDataFrame(rs, "project string, path string, length long, modified long")).first().fingerprint
    assert of(rows) == of(rows[:1]) == of([*rows[:1], ("p", "/a/.git/z.rs", 1, 1)]) and of(rows) != of([("p", "/a/src/x.rs", 4, 1)])


@pytest.mark.parametrize("text,want", [("my-tool_name", "My Tool Name"), ("x", "X"), ("aB-c", "AB C")])
def test_title(spark, text, want):
    assert spark.range(1).select(fn.title_case(F.lit(text))).first()[0] == want


def test_dependents_of_any_depth(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 3)  # a bound of components() only
    links = spark.createDataFrame([("p", f"n{k + 1}", f"n{k}") for k in range(7)], "project string, a string, b string")
    changed = spark.createDataFrame([("p", "n0")], "project string, id string")
    assert sorted(tuple(r) for r in graph.dependents_of(changed, links).collect()) == [("p", f"n{k}", k) for k in range(1, 8)]


def slow_greedy(n, weights):
    """Greedy merging that looks at all pairs of communities each time."""
    label, total = list(range(n)), sum(weights.values())
    while total:
        live = sorted(set(label))
        degree, between = dict.fromkeys(live, 0.0), {}
        for (a, b), w in weights.items():
            x, y = sorted((label[a], label[b]))
            degree[x] += w
            degree[y] += w
            if x != y:
                between[x, y] = between.get((x, y), 0.0) + w
        gains = sorted((-(w / total - degree[x] * degree[y] / (2 * total * total)), x, y) for (x, y), w in between.items())
        if not gains or -gains[0][0] <= 1e-12:
            break
        _, x, y = gains[0]
        label = [x if c == y else c for c in label]
    return label


def test_communities_by_brute_force():
    draw = random.Random(3)
    for _ in range(60):
        n = draw.randint(1, 14)
        weights = {(a, b): float(draw.randint(1, 3)) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.35}
        found = graph.greedy_communities(list(range(n)), weights)
        assert [found[i] for i in range(n)] == slow_greedy(n, weights)


def test_measures_by_brute_force(spark):
    """Modularity and groups of types with shared fields and calls, from plain pair counts."""
    draw = random.Random(5)
    rows = []
    for t in range(6):
        n = draw.randint(2, 9)
        names = [f"m{i}" for i in range(n)]
        for m in range(n):
            touch = sorted(draw.sample(["a", "b", "c", "d", "e", "f"], draw.randint(0, 3)))
            calls = sorted({draw.choice(names) for _ in range(draw.randint(0, 2))} - {names[m]})
            rows.append(("p", t, f"t{t}", ["a", "b", "c", "d", "e", "f"], m, names[m], touch, calls, touch))
    df = spark.createDataFrame(rows, "project string, type_ord long, type string, fields array<string>, m int, method string, touch array<string>, calls array<string>, reads array<string>")
    for r in cohesion.measures(df).collect():
        own = [x for x in rows if x[2] == r.type]
        weights = {}
        for a in own:
            for b in own:
                w = len(set(a[6]) & set(b[6])) + (b[5] in a[7] or a[5] in b[7])
                if a[4] < b[4] and w:
                    weights[a[4], b[4]] = float(w)
        label = slow_greedy(len(own), weights)
        assert [sorted(g) for g in r.groups] == [[i for i, c in enumerate(label) if c == g] for g in sorted(set(label))]
        total = sum(weights.values())
        q = 0.0
        for c in set(label) if total else ():
            inside = sum(w for (a, b), w in weights.items() if label[a] == label[b] == c)
            degree = sum(w * ((label[a] == c) + (label[b] == c)) for (a, b), w in weights.items())
            q += inside / total - (degree / (2 * total)) ** 2
        assert r.modularity == pytest.approx(q)


def _fan(spark, n=300):
    """n entries that lead to one hub, and that to n nodes, one a port that leads further: n * (n + 1) hops over 2 n + 1 links."""
    links = [("p", f"e{i}", "hub") for i in range(n)] + [("p", "hub", f"n{i}") for i in range(n)] + [("p", "n0", "beyond"), ("q", "e0", "n1")]
    entries = spark.createDataFrame([("p", f"e{i}") for i in range(n)] + [("p", "e0"), ("q", "e0"), ("q", None)], "project string, id string")
    stations = [("p", "hub", "x"), ("p", "beyond", "x"), ("q", "n1", None), ("q", "n1", "z")] + [("p", f"n{i}", "y" if i % 2 else "port") for i in range(n)]
    ports = spark.createDataFrame([("p", "n0")], "project string, id string")
    return entries, spark.createDataFrame(links, "project string, a string, b string"), spark.createDataFrame(stations, "project string, id string, pattern string"), ports


def test_a_trace_writes_no_hops(spark, monkeypatch):
    written, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(write(df)) or written[-1])
    monkeypatch.setattr(graph, "ROW_NODES", 7)
    hops = graph.trace(*_fan(spark), carried="pattern")
    found = sorted((tuple(r) for r in hops.select("project", "start", "node", "depth", "is_port", "pattern").collect()), key=repr)
    want = [("p", f"e{i}", "hub", 1, False, "x") for i in range(300)] + [("q", "e0", "n1", 1, False, x) for x in (None, "z")]
    want += [("p", f"e{i}", f"n{k}", 2, k == 0, "y" if k % 2 else "port") for i in range(300) for k in range(300)]
    assert found == sorted(want, key=repr)
    assert max(df.count() for df in written) <= 2 * 300 + 4


def test_a_trace_without_names(spark):
    """A row for each entry, depth and kind of node says as much as the hops do."""
    fan = _fan(spark)
    brief = graph.trace(*fan, carried="pattern", named=False)
    found = [tuple(r) for r in brief.select("project", "start", "depth", "is_port", "pattern").collect()]
    hops = graph.trace(*fan, carried="pattern").select("project", "start", "depth", "is_port", "pattern")
    assert len(found) == 300 * 4 + 2 and set(found) == {tuple(r) for r in hops.collect()}

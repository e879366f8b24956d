from __future__ import annotations

import re
from collections import defaultdict

import pytest

from keelson.llm import exact, mixing, urls
from keelson.llm.queries import URL_RULES

DOCS = "doc_id long, text string, source string, _row string, count long, group_size string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


def brute(rows):
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    return groups


ROWS = [(1, "a b", "s"), (2, "a \t b", "s"), (3, None, "t"), (4, "", None), (5, "a b ", "t"), (6, "é b", None), (None, "a b", "s"), (2, "a b", "s"), (7, "w " * 30_000, "u")]


@pytest.mark.parametrize("tracked,heavy", [(16384, 2048), (8, 1)])
def test_exact(spark, tracked, heavy):
    rows = ROWS + [(100 + i, "hot text", "s") for i in range(300)]
    found = exact.exact_duplicates(docs(spark, rows), tracked=tracked, heavy=heavy).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.text_sha256].append(r)
    assert sorted(len(x) for x in by.values()) == sorted(len(x) for x in brute(rows).values())
    for group in by.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {min(ids) if ids else None} and {r.group_size for r in group} == {len(group)}
        assert sum(r.kept for r in group) == 1 and next(r for r in group if r.kept).doc_id == (min(ids) if ids else None)


def test_exact_empty_and_drop(spark):
    assert exact.exact_duplicates(docs(spark, [])).count() == 0
    kept = exact.drop_exact_duplicates(docs(spark, [*ROWS, (1, "a b", "z")]))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 5, 6, 7], key=str)


def water(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if 3 * sizes[s] <= level * w[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixture(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 3 else "big") for i in range(900)] + [(9001, "x " * 20000, "long"), (9002, None, None), (9003, " \n", None), (9004, "tiny", "a"), (None, "no id", "big")]
    found = mixing.mixture(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    targets = water(dict(sizes))
    taken = defaultdict(int)
    for r in found:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source, target in targets.items():
        if sizes[source] and source != "long":
            assert abs(taken[source] - target) <= 0.25 * target + 10
    again = {(r.doc_id, r.source): r.taken for r in mixing.mixture(docs(spark, rows).repartition(7)).collect()}
    assert again == {(r.doc_id, r.source): r.taken for r in found}
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == docs(spark, []).columns and mixed.count() == sum(r.copies for r in found)


def test_mixture_empty(spark):
    assert mixing.mixture(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mixture(docs(spark, [(1, None, None)])).collect()] == [0]


def test_urls(spark):
    pages = [
        (1, "http://a.example.com/en/7"), (2, "https://EXAMPLE.com/en/8?x=/en/7"), (3, "http://com/en/"), (4, "http://example.company/en/"), (5, None), (6, "no scheme/en/"), (7, ""), (8, "http://x.net/de"),
        (9, "http://x.net/de/#a"), (10, "http://example.net/de/88"), (11, "https://example.com:80/en/7"), (12, "http://notexample.com/en/77"), (12, "http://notexample.com/en/77"), (None, "ftp://a.org/es/x"), (13, "http://a.org?/es/"), (14, "x" * 100_000 + "://b.org/es/"),
        (15, "http://a.org/es/\nmore"), (16, "://org/es/1"),
    ]
    df = spark.createDataFrame([(*p, "r", "t") for p in pages], "page_id long, url string, rule string, token string")
    found = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, URL_RULES).collect()), key=str)

    def slow(i, url):
        host, path = "", ""
        if url and "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
            host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return (i, host, path, best and best.name, best.verdict if best else "allow")

    assert found == sorted((slow(*p) for p in pages), key=str)
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0 and urls.judge_urls(df, []).where("verdict = 'allow'").count() == len(pages)
    pattern = urls.UrlRule("block", "", "", pattern="/en/7+$", tokens=("en",))
    assert sorted(r.page_id for r in urls.judge_urls(df, [pattern]).where("verdict = 'block'").collect()) == [1, 11, 12, 12]
    assert urls.filter_urls(df, URL_RULES).columns == df.columns


def test_urls_by_joins(spark, monkeypatch):
    """Many rules are joined instead of looked up in place; nulls go by the default."""
    rows = [(i, f"http://h{i % 7}.example.{'com' if i % 2 else 'net'}/{['en', 'de'][i % 2]}/{i}") for i in range(60)] + [(100, None), (101, "none"), (100, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, blocked_url string")
    rules = [*URL_RULES, urls.UrlRule("block", "", "", pattern="/5$", tokens=())]
    want = sorted(map(str, urls.judge_urls(df, rules).collect()))
    monkeypatch.setattr(urls, "RULES_IN_PLACE", 0)
    assert sorted(map(str, urls.judge_urls(df, rules).collect())) == want
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert sorted(map(str, urls.judge_urls(df, rules).collect())) == want
    monkeypatch.undo()
    for default in ("allow", "block"):
        judged = [r.page_id for r in urls.judge_urls(df, rules, default).collect() if r.verdict == "allow"]
        assert sorted(map(str, judged)) == sorted(str(r.page_id) for r in urls.filter_urls(df, rules, default).collect())
    assert urls.filter_urls(df, rules, "block").where("url is null").count() == 0


def test_first_of_equal_rows_is_the_same_again(spark):
    rows = [(i % 5, "same  text" if i % 2 else "same text", f"s{i}") for i in range(40)] + [(None, "same text", "z"), (None, None, "y"), (None, "", "x"), (7, "other", "a"), (7, "other", "a")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, key string")
    found = [sorted(map(str, exact.drop_exact_duplicates(d).collect())) for d in (df, df.repartition(5), df.orderBy("source"))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 3
    monkey = sorted(map(str, exact.drop_exact_duplicates(df, heavy=1, tracked=16).collect()))
    assert monkey == found[0] and exact.drop_exact_duplicates(df.limit(0)).count() == 0


def test_large_groups_on_either_path(spark):
    rows = [(i, ["hot", "warm", None, f"t{i // 2}"][i % 4], "r") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    want = sorted(map(str, exact.exact_duplicates(df).collect()))
    assert sorted(map(str, exact.exact_duplicates(df.repartition(9), heavy=1, tracked=16).collect())) == want

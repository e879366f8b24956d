from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import ann, bpe, exact, mixing, queries, quality, simhash

SF = "/root/testdata/sf0.001"


def slow_nearest(rows, k):
    clean = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in clean:
        if i % 100 == 0:
            found = sorted((float(np.sqrt(((np.array(v) - np.array(u)) ** 2).sum())), j) for j, u in clean if j != i and len(u) == len(v))[:k]
            out.setdefault(i, []).extend(found)
    return out


@pytest.mark.parametrize("shard_rows", [150, 10_000])
def test_nearest(spark, shard_rows):
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(700, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] * 8), (2400, [None] * 8), (2500, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2600, [1.0, 2.0]), (2601, [1.0, 3.0]), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, shard string, n int")
    found = ann.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=shard_rows).collect()
    want = slow_nearest(rows, 10)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want) and got[2600] == [(1.0, 2601)]
    hits = total = 0
    for i, best in want.items():
        assert len(got[i]) == len(best) and got[i] == sorted(got[i])
        hits += len({j for _, j in got[i]} & {j for _, j in best})
        total += len(best)
    assert hits >= 0.9 * total
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("sf,shard_rows,probes", [("sf0.01", 200, 32), ("sf0.1", 500, 32), ("sf0.1", 250, 4)])
def test_recall_on_embeddings(spark, sf, shard_rows, probes, monkeypatch):
    """Graphs of several shards, and with fewer probes than cells, against brute force."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    vectors, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    rowset = ann._rows(table, "vec_id", "embedding")
    index, cells = ann.build_index(rowset, 11, shard_rows, probes)
    shards = index.select("cell", "n").collect()
    assert len(shards) >= 2 and (sum(r.n for r in shards) == len(rows)) == (len(shards) <= probes)
    found = {}
    for r in ann.search_index(index, cells, rowset.where("id % 100 = 0"), 10, probes=probes).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in ids[ids % 100 == 0].tolist():
        away = ((vectors - vectors[ids == i][0]) ** 2).sum(axis=1)
        best = [j for j in ids[np.lexsort((ids, away))].tolist() if j != i][:10]
        assert len(found[i]) == 10
        hits, total = hits + len(found[i] & set(best)), total + 10
    assert hits >= 0.9 * total, hits / total


def test_graphs_are_walked():
    """A search looks at a part of the nodes only, and finds nearly all of the nearest."""
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(3000, 12))
    graph = ann.SmallWorld.build(vectors)
    assert all(layer.dtype == np.int32 and layer.shape[0] == 3000 for layer in graph.layers) and len(graph.layers) > 2
    assert ((graph.layers[0] >= 0).sum(axis=1) > 0).all()
    hits = looked = 0
    for k in range(0, 3000, 60):
        before = graph.mark
        found = graph.search(vectors[k], 11, 64)
        looked += int((graph.seen > before).sum())
        hits += len(set(found.tolist()) & set(np.argsort(((vectors - vectors[k]) ** 2).sum(axis=1))[:11].tolist()))
    assert hits >= 0.95 * 11 * 50 and looked < 0.5 * 3000 * 50


def test_crowded_cells_are_split(spark):
    draw = np.random.default_rng(4)
    vectors = np.concatenate([draw.normal(size=(600, 6)) * 0.01 + 5, draw.normal(size=(60, 6)) * 9])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=60).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for i, got in found.items():
        away = ((vectors - vectors[i]) ** 2).sum(axis=1)
        away[i] = np.inf
        assert len(got & set(np.argsort(away)[:10].tolist())) >= 9
    assert len(found) == 7


def test_pipeline(spark):
    """The stages of the pipeline against a plain loop over their own decisions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.quality_model(spark, docs, SF)
    rows = [r for r in docs.collect() if model.score(r.text) >= 0.3]
    seen, first = set(), []
    for r in sorted(rows, key=lambda r: r.doc_id):
        key = " ".join((r.text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" "))
        while "  " in key:
            key = key.replace("  ", " ")
        if key not in seen:
            seen.add(key)
            first.append(r)
    prints = np.array([simhash.fingerprint(r.text) for r in first], np.int64).view(np.uint64)
    roots = simhash.vantage_links(prints) if len(set(prints.tolist())) == len(prints) else None
    label = np.arange(len(first))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    while True:
        new = np.where(near, label[None, :], len(label)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert roots is None or (roots == label).all()
    kept = [r for k, r in enumerate(first) if label[k] == k]
    copies = {r.doc_id: r.copies for r in mixing.mixture(spark.createDataFrame(kept, docs.schema)).collect()}
    tokens = bpe.tokenizer(queries.RANK_FILE, queries.public_tokenizers.PATTERN)
    want = []
    for r in kept:
        ids = tokens.encode(r.text or "").tolist()
        want += [(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * copies[r.doc_id]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert exact.drop_exact_duplicates(docs).count() <= docs.count() and quality.SAMPLE > 0


CLASHES = ("score", "fp", "row", "key", "rate", "copy", "from_source", "label", "labelled", "n", "first", "host")


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    odd = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "one two three four five six", "en", "a", 1), (3, "word " * 60_000, "en", None, 9), (4, "twice the same text", "en", "b", 2), (4, "twice the same text", "en", "b", 2), (4, "twice the same text", "en", "c", 2), (None, None, None, None, None), (5, " \t\n", "de", "a", 3)]
    docs = spark.createDataFrame(odd, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "text", "lang", "source", "n_chars"))).select(*base.columns)
    docs = docs.withColumns({c: F.lit("kept") for c in CLASHES if c not in docs.columns})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "bpe":
            assert len(rows) == len(odd)
            assert stage(spark, docs.limit(0), SF).count() == 0
            continue
        assert out.columns == docs.columns and all(r[c] == "kept" for r in rows for c in CLASHES)
        assert {(r.doc_id, r.text) for r in rows} <= {(r[0], r[1]) for r in odd}
        if name == "exact_dedup":
            assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in rows) == [("1", ""), ("3", "word "), ("4", "twice"), ("5", " \t\n"), ("None", "one t")]
        if name == "near_dedup":
            assert sum((r.text or "").strip() == "" for r in rows) == 1 and len(rows) == 4
    table = quality.fit_quality(docs.limit(0), spark.read.parquet(f"{SF}/labels.parquet").limit(0), F.lit(False))
    assert table.score("any") == 0.5

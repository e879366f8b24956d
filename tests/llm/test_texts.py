from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from keelson.llm import bpe, langid, quality, queries, secrets, simhash, substring
from keelson.llm.queries import RANK_FILE

SCHEMA = "doc_id long, text string, lang string, fp string, row string, words string"
ODD = [(1, None, "en"), (2, "", "en"), (3, "a", None), (4, "a", "en"), (4, "a", "en"), (None, "one two three four five", "en"), (5, " \t\n\x0b\x0c\r", "de"), (6, "word " * 40_000, "en"), (7, "123 456 !!", "en"), (8, "漢字 ß É \U0001f600", "xx")]


def table(spark, rows=ODD):
    return spark.createDataFrame([(*r, "c", "d", "e") for r in rows], SCHEMA)


def test_bpe_round_trip(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tokenizer(RANK_FILE, public_tokenizers.PATTERN).ranks, special_tokens={})
    draw = random.Random(4)
    rows = ODD + [(100 + i, "".join(draw.choice("ab c'sdtre \t\n\x1c\x85\xa0éß漢1½!?\U0001f600\x00") for _ in range(draw.randint(0, 60))), "en") for i in range(300)] + [(900, "a" * 5000 + "ab" * 900 + "\n" * 300, "en")]
    tokens = bpe.tokenise(table(spark, rows), RANK_FILE, public_tokenizers.PATTERN)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.with_digests(tokens).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {text: enc.encode_ordinary(text or "") for _, text, _ in rows}
    want = sorted(((i, len(ids[text]), sha(",".join(map(str, ids[text])).encode()), sha((text or "").encode())) for i, text, _ in rows), key=str)
    assert got == want
    assert bpe.tokenise(table(spark, []), RANK_FILE, public_tokenizers.PATTERN).count() == 0
    decoded = {bytes(r.decoded) for r in bpe.decode(tokens, RANK_FILE).collect()}
    assert decoded == {(text or "").encode() for _, text, _ in rows}


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(points, radius=4):
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    label = np.arange(len(points))
    while True:
        new = np.where(near, label[None, :], len(points)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_simhash(spark):
    draw = random.Random(2)
    base = [" ".join(draw.choice(["alpha", "Beta", "c", "é", "dd"]) + str(draw.randint(0, 30)) for _ in range(draw.randint(1, 300))) for _ in range(30)]
    rows = ODD + [(1000 + i, base[i % 30].replace("1", "7", i // 30 % 4), "en") for i in range(240)]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect()), key=str)
    prints = [slow_fingerprint(t) for _, t, _ in rows]
    label = slow_components(np.array(prints, np.uint64))
    first = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in set(label)}
    assert got == sorted(((rows[k][0], format(prints[k], "016x"), first[label[k]]) for k in range(len(rows))), key=str)
    kept = simhash.drop_near_duplicates(table(spark, rows))
    assert kept.columns == table(spark).columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(table(spark, [])).count() == 0 and simhash.drop_near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("copies,flips", [(1, 0), (40, 2), (400, 3)])
def test_vantage_trees(copies, flips):
    draw = np.random.default_rng(flips)
    points = np.repeat(draw.integers(0, 1 << 63, 2000 // copies).astype(np.uint64), copies)
    for _ in range(flips):
        points = points ^ (np.uint64(1) << draw.integers(0, 64, len(points)).astype(np.uint64))
    points = np.unique(points)
    assert (simhash.vantage_links(points) == slow_components(points)).all()


def test_shards_too_dense_to_cut(spark):
    draw = np.random.default_rng(9)
    points = np.repeat(draw.integers(0, 1 << 62, 12).astype(np.uint64), 60)
    for _ in range(5):
        points = points ^ (np.uint64(1) << draw.integers(0, 64, len(points)).astype(np.uint64))
    points = np.unique(points)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    where = {int(p): k for k, p in enumerate(points.view(np.int64))}
    up = list(range(len(points)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in simhash.link_fingerprints(df, shard_points=5).collect():
        a, b = sorted((find(where[r.a]), find(where[r.b])))
        up[b] = a
    assert [find(i) for i in range(len(points))] == slow_components(points).tolist()


def test_trees_carry_the_links(spark):
    """On documents: every near pair meets in a shard cut from vantage points, boundary points are
    in two shards, trees cut and prune, and what they link is what all pairs link."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    points = np.unique(np.array([simhash.fingerprint(r.text) for r in docs.collect()], np.int64).view(np.uint64))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    shards, places = {}, {}
    for r in simhash.shards(df, shard_points=100).collect():
        shards.setdefault(r.shard, []).append(r.fp)
        places.setdefault((r.part, r.fp), set()).add(r.shard)
    assert len(places) == simhash.PARTS * len(points) and len(shards) > 10 * simhash.PARTS
    assert sum(len(x) > 1 for x in places.values()) > len(points)  # in reach of a ring's boundary
    near = np.argwhere(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= simhash.RADIUS, 1))
    assert len(near)
    for a, b in points.view(np.int64)[near].tolist():
        assert any(places[part, a] & places[part, b] for part in range(simhash.PARTS))
    count, label = Counter(), np.arange(len(points))
    for mask in simhash.part_masks():
        roots = simhash.vantage_links(points, mask=mask, bound=simhash.RADIUS // simhash.PARTS, count=count)
        label = np.minimum(label, roots)
    assert count["cuts"] > 3 * len(points) // simhash.LEAF and count["pruned"] > count["asked"] / 10
    linked = {tuple(sorted((r.a, r.b))) for r in simhash.link_fingerprints(df, shard_points=100).collect()}
    whole = simhash.link_fingerprints(df).collect()
    for links in (linked, {(r.a, r.b) for r in whole}):
        up = {int(p): int(p) for p in points.view(np.int64)}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[find(a)] = find(b)
        roots = [find(int(p)) for p in points.view(np.int64)]
        slow = slow_components(points).tolist()
        assert len(set(roots)) == len(set(slow)) == len(set(zip(roots, slow, strict=True)))


def test_language(spark):
    draw = random.Random(1)
    words = {"en": ["the", "and", "thing", "ough", "wh"], "de": ["sch", "ung", "über", "ein", "ß"], "fr": ["eau", "ç", "que", "é", "ment"]}
    text = lambda lang, n: " ".join("".join(draw.choice(words[lang]) for _ in range(3)) for _ in range(n))
    rows = ODD + [(i + 100, text(lang, 1 + i % 60), lang) for i in range(300) for lang in [list(words)[i % 3]]]
    docs = table(spark, rows).withColumn("score", F.lit("clash"))
    model = langid.fit_languages(docs, F.col("doc_id") % 4 == 2)
    assert model.languages == ["de", "en", "fr", "xx"]
    found = {r.doc_id: r for r in langid.predict_languages(docs, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 5, 7))
    held = [(i, lang) for i, _, lang in rows if i and i >= 100 and i % 4 == 2]
    assert sum(found[i].lang_pred == lang for i, lang in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    none = langid.fit_languages(table(spark, []), F.lit(False))
    assert langid.predict_languages(table(spark), none).where("lang_pred != 'und'").count() == 0


def slow_profile(text):
    """The bundle of a text's n-grams by plain loops: None without a letter."""
    letters = "".join(c if c.isalpha() else "\0" for c in f"\0{text.lower()}\0")
    while "\0\0" in letters:
        letters = letters.replace("\0\0", "\0")
    if len(letters) < 3:
        return None
    vector = lambda c: np.random.Generator(np.random.PCG64(ord(c))).integers(0, 2, langid.DIMENSIONS, np.int8) * 2 - 1
    return sum(np.roll(vector(a), 2).astype(int) * np.roll(vector(b), 1) * vector(c) for a, b, c in zip(letters, letters[1:], letters[2:], strict=False))


def test_language_by_brute_force(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("The cat sat.", "en"), ("on the mat, oh!", "en"), ("Über die Straße", "de"), ("ein Haus", "de"), ("l'eau ça", "fr"), ("x" * 300, "fr"), ("12 .. !", "fr"), (None, "en"), ("held out Wörter", "de"), ("the house", None), ("", "de")])]
    model = langid.fit_languages(table(spark, rows), F.col("doc_id") == 8)
    sums = {}
    for i, text, lang in rows:
        profile = slow_profile(text or "")
        if i != 8 and lang and profile is not None:
            sums[lang] = sums.get(lang, 0) + profile / np.linalg.norm(profile)
    assert model.languages == sorted(sums)
    for r in langid.predict_languages(table(spark, rows), model).collect():
        profile = slow_profile(rows[r.doc_id][1] or "")
        if profile is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {lang: float(profile @ v / np.linalg.norm(profile) / np.linalg.norm(v)) for lang, v in sums.items()}
        assert r.lang_pred == max(cosines, key=lambda k: (cosines[k], k)) and r.score == pytest.approx(min(1, max(0, max(cosines.values()))), abs=1e-4)


def slow_features(text):
    """Buckets and weights of a text by plain loops."""
    mod, step = 1 << 64, int(quality.STEP)
    bucket = lambda h: (((h ^ (h >> 29)) * int(quality.FINISH)) % mod) >> (64 - quality.BUCKET_BITS)
    out, words = Counter(), (text or "").split()

    def whole(word):
        return sum(ord(c) * pow(step, k + 1, mod) for k, c in enumerate(f"<{word}>")) % mod

    for word in words:
        out[bucket(whole(word))] += 1
        marked = f"<{word}>"
        for n in quality.GRAMS:
            for k in range(len(marked) - n + 1):
                h = n
                for c in marked[k : k + n]:
                    h = (h * step + ord(c)) % mod
                out[bucket(h * step % mod)] += 1
    for a, b in zip(words, words[1:], strict=False):
        out[bucket((whole(a) * int(quality.PAIR) + whole(b) * step) % mod * step % mod)] += 1
    return out


def slow_train(rows, totals):
    """The same descent by plain loops over numbers."""
    draw = np.random.default_rng(quality.SEED)
    d = quality.DIMENSIONS
    vectors = draw.uniform(-1 / d, 1 / d, (1 << quality.BUCKET_BITS, d)).astype(np.float32).astype(float)
    out, bias = np.zeros((2, d)), [0.0, 0.0]
    steps, done = quality.EPOCHS * len(rows), 0
    for _ in range(quality.EPOCHS):
        for k in draw.permutation(len(rows)):
            weights, label = rows[k]
            speed = quality.RATE * (1 - done / steps)
            done += 1
            hidden = [sum(w * vectors[b][j] for b, w in weights.items()) for j in range(d)]
            z = [sum(out[c][j] * hidden[j] for j in range(d)) + bias[c] for c in (0, 1)]
            p1 = 1 / (1 + np.exp(z[0] - z[1]))
            error = [(1 - p1) - (label == 0), p1 - (label == 1)]
            back = [error[0] * out[0][j] + error[1] * out[1][j] for j in range(d)]
            size = sum(w * w for w in weights.values())
            for c in (0, 1):
                for j in range(d):
                    out[c][j] -= speed * error[c] * hidden[j]
                bias[c] -= speed * error[c]
            for b, w in weights.items():
                for j in range(d):
                    vectors[b][j] -= w * speed * back[j] / size
    have = Counter(label for _, label in rows)
    return (vectors @ (out[1] - out[0])), bias[1] - bias[0] + np.log(totals[1] / totals[0]) - np.log(have[1] / have[0])


def test_quality_by_brute_force(spark):
    texts = ["a good clean line", "buy buy buy $$$", "Überall ein Satz", "win win", "the end of it", "", "a b\tc a b", "$$$ win 漢字"]
    labels = [1, 0, 1, 0, 1, 0, 1, 0]
    for text in [*texts, None, "x" * 200, " \n "]:
        buckets, weights = quality.features(text)
        got = Counter()
        for b, w in zip(buckets.tolist(), weights.tolist(), strict=True):
            got[b] += w
        assert got == slow_features(text)
    rows = []
    for text, label in zip(texts, labels, strict=True):
        found = slow_features(text)
        total = sum(found.values())
        rows.append(({b: w / total for b, w in found.items()}, label))
    model = quality.train([(*quality.packed(t), y) for t, y in zip(texts, labels, strict=True)], (4, 4))
    gains, bias = slow_train(rows, (4, 4))
    assert model.bias == pytest.approx(bias, abs=1e-3) and np.abs(model.gains - gains).max() < 1e-3
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    for r in quality.score_quality(df, model).collect():
        found = slow_features([*texts, None][r.doc_id])
        logit = bias + (sum(gains[b] * w for b, w in found.items()) / sum(found.values()) if found else 0)
        assert r.score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-3) and r.predicted == (r.score >= 0.3)


def test_held_out_accuracy(spark):
    """On the tables themselves: rows that neither model has learnt from."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = [r for r in queries.op4_langid(spark, sf).collect() if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert len(found) > 100 and sum(r.lang_pred == docs[r.doc_id].lang for r in found) >= 0.97 * len(found)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in queries.op10_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(found) > 30 and sum(r.predicted == labels[r.doc_id] for r in found) >= 0.95 * len(found)


def test_quality(spark):
    draw = random.Random(3)
    good = lambda: " ".join(draw.choice(["tion", "the", "ing", "an"]) + draw.choice(["er", "st", ""]) for _ in range(60)) + "."
    bad = lambda: " ".join(draw.choice(["HEY!!", "win$$$", "a | b"]) for _ in range(60)) if draw.random() < 0.5 else " ".join(w for w in good().split()[:4] for _ in range(15))
    rows = ODD + [(100 + i, good() if i % 4 else bad(), "en") for i in range(600)]
    labels = spark.createDataFrame([(100 + i, int(i % 4 > 0), 0) for i in range(600)] + [(1, None, 0), (None, 1, 0), (6, 7, 0), (101, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(table(spark, rows), labels, F.col("doc_id") % 5 == 0)
    found = {r.doc_id: r for r in quality.score_quality(table(spark, rows), model).collect()}
    held = [(100 + i, int(i % 4 > 0)) for i in range(600) if i % 5 == 0]
    assert sum(found[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values()) and found[1].score == found[2].score
    again = quality.fit_quality(table(spark, rows).repartition(5), labels, F.col("doc_id") % 5 == 0)
    assert (again.gains == model.gains).all() and again.bias == model.bias
    assert quality.keep_good(table(spark, rows), model).columns == table(spark).columns
    one = quality.fit_quality(table(spark, rows), labels.where("quality = 1"), F.lit(False))
    assert quality.score_quality(table(spark), one).where("predicted = 1").count() == len(ODD)
    assert quality.score_quality(table(spark, []), one).count() == 0


HEX = "0123456789abcdef0123"
SECRETS = [
    (1, None), (2, ""), (3, f"password={HEX}"), (4, 'API_KEY" : "abc/+=._-9XYZw" end'), (5, "AKIA" + "Q" * 14 + "x AKIA123"), (6, "token=short paſſword=abcdefghijklmnop"), (7, "İ password = " + "Zq7" * 8 + " 漢 " + HEX),
    (8, "the secret access key is qT7xVb93LmPz0RwKe4Yh for now"), (9, "a plain text about a private garden and its author"), (9, "x " * 50_000 + "secret:abcdefghijkl"), (None, HEX + " " + HEX),
]


def test_secrets(spark):
    df = spark.createDataFrame([(*r, "c") for r in SECRETS], "doc_id long, text string, found string")
    got = secrets.with_digests(secrets.scan_secrets(df)).collect()

    def slow(text):
        text = text or ""
        key = "".join
        words = "|".join(key(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
        a = [(m.start(), 0, m.end()) for m in re.finditer(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]
        b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        spans = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(a + b + c))
        return len(a), len(b), len(c), hashlib.sha256(spans.encode()).hexdigest()

    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=str) == sorted(((i, *slow(t)) for i, t in SECRETS), key=str)
    novel = {r.doc_id: r.spans for r in got if r.n_novel}
    assert novel == {8: "novel:25:45"}
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_chains_by_brute_force():
    draw = random.Random(5)
    for _ in range(60):
        n = draw.randint(1, 9)
        pos, other = np.array([draw.randint(0, 60) for _ in range(n)]), np.array([draw.randint(0, 60) for _ in range(n)])

        def best(last):
            """Worth of the best chain that ends in a match, over all its predecessors."""
            options = [min(sub - substring.GAP_COST * (pos[last] - pos[k] + other[last] - other[k] - 2 * substring.SEED_WORDS), sub) for k in range(n) if pos[k] < pos[last] and other[k] < other[last] for sub in [best(k)]]
            return substring.SEED_WORTH + max([0.0, *options])

        def worth(chain):
            steps = [min(0.0, -substring.GAP_COST * (pos[b] - pos[a] + other[b] - other[a] - 2 * substring.SEED_WORDS)) for a, b in zip(chain, chain[1:], strict=False)]
            return substring.SEED_WORTH * len(chain) + sum(steps)

        found = substring.chains(pos, other)
        assert sorted(np.concatenate(found).tolist()) == list(range(n))
        for chain in found:
            assert (np.diff(pos[chain]) > 0).all() and (np.diff(other[chain]) > 0).all()
        # the first chain is the best of all; each later one may only lose what earlier ones have taken
        assert worth(found[0].tolist()) == pytest.approx(max(best(k) for k in range(n)))
        for chain in found[1:]:
            assert worth(chain.tolist()) <= best(int(chain[-1])) + 1e-9


def test_passages(spark):
    draw = random.Random(7)
    fresh = lambda n: [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
    shared, long = fresh(60), fresh(900)
    fuzzy = [w if k % 17 else "x" for k, w in enumerate(fresh(120))]
    noisy = [w if k % 23 != 5 else f"y{k}" for k, w in enumerate(fuzzy)]
    rows = [(1, fresh(40) + shared + fresh(10)), (2, fresh(5) + shared), (3, shared + fresh(200)), (4, fresh(300)), (5, long), (6, fresh(30) + long[100:700]), (7, fresh(12) + fuzzy), (8, noisy + fresh(9)), (9, fresh(80) + shared[:45]), (None, fresh(20) + shared), (10, shared * 2)]
    docs = spark.createDataFrame([(i, " ".join(w), "c") for i, w in rows] + [(11, None, "c"), (12, "", "c"), (13, "ha " * 30_000, "c"), (14, "one two", "c")], "doc_id long, text string, row string")
    found = substring.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == {1, 2, 3, 5, 6, 7, 8, 10, None}
    texts = {i: w for i, w in rows}
    for r in found:
        assert r.end_word - r.start_word > 50 and r.similarity >= 0.8
    spans = {r.doc_id: (r.start_word, r.end_word) for r in found if r.doc_id in (1, 2, 3)}
    assert all(texts[i][s:e] == shared for i, (s, e) in spans.items())
    assert next((r.start_word, r.end_word) for r in found if r.doc_id == 6) == (30, 630)
    assert substring.repeated_passages(docs.limit(0)).count() == 0


def test_partitions_do_not_change_passages(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(substring, "HOT_ROWS", 1)
    found = [sorted(map(str, substring.repeated_passages(d).collect())) for d in (docs, docs.repartition(7))]
    monkeypatch.undo()
    found.append(sorted(map(str, substring.repeated_passages(docs).collect())))  # hot texts or none
    assert found[0] and found[0] == found[1] == found[2]


def test_exact_passages_by_brute_force(spark):
    """Every word of every exact passage of 51 words that two rows share lies in a span found there."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    size, where = substring.MIN_WORDS + 1, {}
    words = {r.doc_id: (r.text or "").lower().split() for r in docs}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            where.setdefault(hash(tuple(w[k : k + size])), set()).add(i)
    found = {}
    for r in substring.repeated_passages(spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    wanted = missed = 0
    for i, w in words.items():
        shared = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if len(where[hash(tuple(w[k : k + size]))]) > 1:
                shared[k : k + size] = True
        covered = np.zeros(len(w), bool)
        for s, e in found.get(i, []):
            covered[s:e] = True
        wanted, missed = wanted + int(shared.sum()), missed + int((shared & ~covered).sum())
        assert not shared.any() or i in found
    assert wanted > 10_000 and missed <= 0.003 * wanted, (wanted, missed)


def linked(a, b):
    """Spans of the passages found between two lists of words, without Spark."""
    (p, h), (q, g) = (substring.seeds(substring.word_hashes(" ".join(x))) for x in (a, b))
    met = np.array([(i, j) for i, x in zip(p, h, strict=True) for j, y in zip(q, g, strict=True) if x == y], np.int64).reshape(-1, 2)
    if not len(met):
        return []
    brief = [(substring.word_hashes(" ".join(x)) >> np.uint64(48)).astype("<u2") for x in (a, b)]
    return [s for pos, other in substring.passages(met[:, 0], met[:, 1]) for s in substring.spans(*brief, pos, other, substring.SIMILARITY, substring.MIN_WORDS)]


@pytest.mark.parametrize("first,gap,inserted,second,parts", [(55, 25, 0, 30, 1), (55, 28, 0, 55, 2), (60, 25, 25, 30, 1), (60, 0, 0, 0, 1)])
def test_parts_of_joint_chains(first, gap, inserted, second, parts):
    draw = random.Random(first + gap + second)
    fresh = lambda n: [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
    for _ in range(40):
        x, y = fresh(first), fresh(second)
        a, b = fresh(70) + x + fresh(gap) + y + fresh(70), fresh(40) + x + (fresh(gap) if not inserted else []) + y + fresh(70)
        found = linked(a, b)
        if parts == 1:
            assert any(s <= 70 and e >= 70 + first for s, e, *_ in found)
        else:
            assert all(any(s <= at and e >= at + n for s, e, *_ in found) for at, n in ((70, first), (70 + first + gap, second)))
        for s, e, t, u, like in found:
            assert min(e - s, u - t) > substring.MIN_WORDS and like >= substring.SIMILARITY


def test_short_passages_with_many_changes():
    draw = random.Random(11)
    fresh = lambda n: [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
    for n, changed, least in ((51, 0.15, 57), (55, 0.18, 57), (60, 0.18, 57), (80, 0.18, 57), (55, None, 42)):  # None: every fifth word
        found = 0
        for _ in range(60):
            a = fresh(n)
            b = a[:]
            for k in draw.sample(range(1, n - 1), int(n * changed)) if changed else range(4, n, 5):
                b[k] = fresh(1)[0]
            found += bool(linked(fresh(70) + a + fresh(70), fresh(45) + b + fresh(70)))
        assert found >= least, (n, changed, found)


@pytest.mark.parametrize("lines,size", [(2, 30), (3, 20), (5, 12)])
def test_passages_of_frequent_lines(spark, lines, size, monkeypatch):
    """Each line of the shared passages is in other documents before and in between."""
    monkeypatch.setattr(substring, "FREQUENT", 3)
    draw = random.Random(lines)
    fresh = lambda n: [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(30):
        parts = [fresh(size) for _ in range(lines)]
        alone = lambda: [fresh(50) + p + fresh(50) for p in parts]  # noqa: B023, E731
        both = [fresh(20) + sum(parts, []) + fresh(20) for _ in range(2)]
        block = [*alone(), both[0], *alone(), both[1], *alone()]
        want |= {len(rows) + lines, len(rows) + 2 * lines + 1}
        rows += block
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").coalesce(1)
    found = substring.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == want


@pytest.mark.parametrize("piece,few", [(7, 16), (14, 16), (14, 2)])
def test_links_of_frequent_seeds_only(spark, piece, few, monkeypatch):
    """All seeds that two texts share are frequent, their first texts are others, and no 32 words in a row are equal."""
    monkeypatch.setattr(substring, "FREQUENT", 3)
    monkeypatch.setattr(substring, "FEW", few, raising=False)
    draw = random.Random(piece)
    fresh = lambda n: [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
    shared = fresh(70)
    a, b = shared, [w if k not in (17, 35, 53) else f"z{k}" for k, w in enumerate(shared)]

    def last(words):
        """A text of these words whose hash is positive, so that it is the first of no frequent seed."""
        while True:
            text = fresh(30) + words + fresh(20)
            h = substring.word_hashes(" ".join(text))
            h = h * (np.arange(len(h), dtype=np.uint64) * substring.STEP + substring.FINISH | np.uint64(1))
            if (h ^ (h >> np.uint64(32))).sum(dtype=np.uint64).view(np.int64) > 0:
                return text

    rows = [last(a), last(b)]
    for _ in range(12):
        rows += [fresh(30) + x[k : k + piece] + fresh(30) for x in (a, b) for k in range(0, 70 - piece + 1)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    found = substring.repeated_passages(docs).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(0, 1), (1, 0)}


@pytest.mark.parametrize("few", [16, 2])
def test_links_by_brute_force(spark, few, monkeypatch):
    """Near copies in a group, each linked to the others at a common line's two ends: all links are rows or within a class."""
    monkeypatch.setattr(substring, "FEW", few, raising=False)
    draw = random.Random(21)
    fresh = lambda n: [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
    line, rows = fresh(12), []
    for _ in range(12):  # families that share the line, and nothing else
        head, tail = fresh(25), fresh(25)
        for _ in range(3):
            copy = head + line + tail
            for k in draw.sample([*range(1, 24), *range(38, 61)], 5):
                copy[k] = fresh(1)[0]
            rows.append(fresh(20) + copy + fresh(20))
    rows += [fresh(40) + line + fresh(40) for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    near = {}
    for r in substring.repeated_passages(docs).collect():
        near.setdefault(r.doc_id, set()).add(r.other_id)
    wanted = {(i, j) for i in range(36) for j in range(36) if i != j and linked(rows[i], rows[j])}
    assert len(wanted) > 50
    for i, j in wanted:
        assert j in near[i] or near[i] & near[j], (i, j)
    assert all(i // 3 == j // 3 and i < 36 for i, js in near.items() for j in js)


def test_common_seeds_send_few_matches(spark, monkeypatch):
    """Texts of one class send the matches of neighbouring seeds with their leader, not of any two; two classes send one row."""
    monkeypatch.setattr(substring, "FEW", 4)
    draw = random.Random(5)
    fresh = lambda n: [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
    shared, rows = fresh(120), []
    for k in range(40):
        text = fresh(20) + shared + fresh(20)
        text[60 + k % 2] = "changed"
        rows.append((k, " ".join(text)))
    read = substring.materialise(substring._read(spark.createDataFrame([(k, k, t) for k, t in rows], "row long, doc_id long, text string"), 50))
    _, common = substring._matches(read, 64)
    sent = substring._crowded(substring._marked(read, common), 64, 50, 0.8).select("data").collect()
    kept = len(substring.seeds(substring.word_hashes(" ".join(shared)))[0])
    assert 40 < sum(len(r["data"]) for r in sent) // 24 < 5 * 40 * kept  # 24 bytes a match
    near = {}
    for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        near.setdefault(r.doc_id, set()).add(r.other_id)
    assert all(j in near[i] or near[i] & near[j] for i in range(40) for j in range(i))


def test_long_secrets():
    draw = random.Random(8)
    key = "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(5000))
    for before, size in (("private_key=", 1600), ("Authorization: Bearer ", 250), ("Authorization: Bearer ", 200), ("credential ", 201), ("the secret access key is ", 5000)):
        text = f"{before}{key[:size]} and further text"
        assert (len(before), 3, len(before) + size) in secrets.find_secrets(text)


def test_secrets_with_few_digits():
    draw = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for size in (16, 20, 32):
        for digits in (0, 1, 2):
            for _ in range(30):
                key = [draw.choice(letters) for _ in range(size)]
                for k in draw.sample(range(size), digits):
                    key[k] = draw.choice("0123456789")
                found = "".join(key)
                assert (11, 3, 11 + size) in secrets.find_secrets(f"credential {found} end"), found
    for name in ("getUserAccountSettings", "a-long-hyphenated-name", "Path/Toward/SomeOther/Place", "UPPER_CASE_CONSTANT_NAME"):
        assert not secrets.find_secrets(f"the auth {name} end")


@pytest.mark.parametrize("size,least", [(20, 0.6), (40, 0.85), (200, 1.0), (1000, 1.0), (5000, 1.0)])
def test_secrets_of_lower_case_letters(size, least):
    draw = random.Random(size)
    before, after = "The account that we made last year has a credential ", " which is written here for all to see, and it works."
    hits = 0
    for _ in range(20):
        key = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
        hits += (len(before), 3, len(before) + size) in secrets.find_secrets(before + key + after)
    assert hits >= least * 20, hits


def slow_novel(text):
    """Novel spans by a plain loop over all runs and all sensitive words."""
    out, lowered = [], text.lower()
    taken = secrets.base_spans(text, lowered)
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        s, e = m.span()
        while text[s] == "=":
            s += 1
            if s == e:
                break
        ends = [k + len(w) for w in secrets.CONTEXT_WORDS for k in range(len(text)) if lowered.startswith(w, k)]
        if e - s < 16 or not any(x <= s <= x + secrets.REACH for x in ends) or any(a < e and s < b for a, _, b in taken):
            continue
        if secrets.novelty().is_novel(text[max(0, s - secrets.AROUND) : s], text[s:e], text[e : e + secrets.AROUND]):
            out.append((s, 3, e))
    return out


def test_novel_spans_by_plain_loop():
    draw = random.Random(12)
    key = lambda n: "".join(draw.choice("ABCDEFGHJKabcdefghjk0123456789+/") for _ in range(n))
    for _ in range(40):
        parts = [draw.choice([key(draw.randint(3, 60)), draw.choice(["auth ", "the credential: ", "private ", "signature of ", "a token ", "plain words here ", "getTheAccountOfTheUser ", "x " * 30])]) for _ in range(12)]
        text = " ".join(parts)
        lowered = text.lower()
        assert secrets.novel_spans(text, lowered, secrets.base_spans(text, lowered)) == slow_novel(text)


def test_clean_texts_hold_no_novel_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kinds = secrets.scan_secrets(docs).select(F.explode("found.kind").alias("kind")).groupBy("kind").count().collect()
    assert {r["kind"] for r in kinds} <= {"assign", "access", "hex"}

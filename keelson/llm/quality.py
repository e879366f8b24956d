"""Quality classifier on hashed word and character n-gram vectors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .shared import materialise, unused

BUCKET_BITS, DIMENSIONS = 16, 16
#: Lengths of the character n-grams of a word between its boundary marks.
GRAMS = (3, 4, 5)
#: At most about so many labelled rows of each class are learnt from, drawn by hash of doc_id.
SAMPLE = 1500
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Buckets of a document that is learnt from, at most; with SAMPLE it bounds what the driver gets
#: to 2 * SAMPLE * MOST_BUCKETS * 6 bytes, 150 MB. Scores always use all buckets.
MOST_BUCKETS = 8192
#: Multipliers of the rolling hashes: odd, with well-mixed bits.
STEP, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * FINISH
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


#: What the hash of a word is multiplied by to make one of a pair with the next word.
PAIR = np.uint64(0xA0761D6478BD642F)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their weights for a whole text; a bucket may come several times.

    Words are runs without white space, case kept. Each distinct word gives itself and its
    character n-grams, and each pair of neighbouring words one of its own, weighted by how often
    they occur.
    """
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts = Counter(words)
    often = np.fromiter(counts.values(), np.float32, len(counts))
    place = dict(zip(counts, range(len(counts)), strict=True))
    order = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    marked = np.frombuffer(("<" + "><".join(counts) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, counts), np.int64, len(counts)) + 2
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), STEP, np.uint64))
        places = np.arange(len(marked)) - np.repeat(starts, lengths)
        whole = np.add.reduceat(marked * powers[places], starts)
        pairs = whole[order[:-1]] * PAIR + whole[order[1:]] * STEP
        out = [_buckets(whole), _buckets(pairs * STEP)]
        weights = [often, np.ones(len(pairs), np.float32)]
        for n in GRAMS:
            if len(marked) < n:
                continue
            inside = np.flatnonzero(word[n - 1 :] == word[: len(word) - n + 1])
            gram = np.full(len(inside), n, np.uint64)
            for k in range(n):
                gram = gram * STEP + marked[inside + k]
            out.append(_buckets(gram * STEP))
            weights.append(often[word[inside]])
    return np.concatenate(out), np.concatenate(weights)


def packed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """features() with each bucket once, weights summing to 1."""
    buckets, weights = features(text)
    if not len(buckets):
        return buckets, weights
    once, place = np.unique(buckets, return_inverse=True)
    summed = np.bincount(place, weights)
    return once, (summed / summed.sum()).astype(np.float32)


def _thinned(buckets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most MOST_BUCKETS of them, those of the smallest hashes, weights summing to 1."""
    if len(buckets) <= MOST_BUCKETS:
        return buckets, weights
    with np.errstate(over="ignore"):
        mixed = (buckets.astype(np.uint64) + np.uint64(1)) * FINISH
    kept = np.sort(np.argpartition(mixed ^ (mixed >> np.uint64(32)), MOST_BUCKETS)[:MOST_BUCKETS])
    return buckets[kept], (weights[kept] / weights[kept].sum()).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """logit = bias + weighted mean of gains over a text's features.

    gains is what the vectors and the output layer come to, bucket by bucket.
    """

    gains: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        buckets, weights = features(text)
        logit = self.bias
        if len(buckets):
            logit += float((self.gains[buckets] * weights).sum(dtype=np.float64) / weights.sum(dtype=np.float64))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))

    def column(self, text: Column) -> Column:
        """The score of a text column, on the executors."""

        @F.pandas_udf(DoubleType())
        def scored(texts: pd.Series) -> pd.Series:
            return pd.Series([self.score(t) for t in texts], dtype="float64")

        return scored(text.cast("string"))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], totals: tuple[int, int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Stochastic gradient descent over rows of (buckets, weights, label 0 or 1).

    Document vectors are weighted means of bucket vectors; a softmax layer gives two classes.
    The step on the bucket vectors is divided by the squared weights' sum, so that a long
    text's vector moves as far as a short one's. totals are the class sizes that the sample was
    drawn from; the bias is moved by the difference of the log odds.
    """
    n0, n1 = totals
    have = Counter(label for *_, label in rows)
    if not have[0] or not have[1]:
        return QualityModel(np.zeros(1 << BUCKET_BITS, np.float32), math.log((n1 + 1) / (n0 + 1)))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            buckets, weights, label = rows[k]
            speed = rate * (1 - done / steps)
            done += 1
            known = vectors[buckets]
            hidden = weights @ known
            z = out @ hidden + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[label] -= 1
            back = error @ out
            out -= speed * np.outer(error, hidden)
            bias -= speed * error
            if len(buckets):
                vectors[buckets] = known - np.outer(weights, speed * back / (weights @ weights))
    gains = vectors @ (out[1] - out[0])
    moved = math.log(n1 / n0) - math.log(have[1] / have[0])
    return QualityModel(gains, float(bias[1] - bias[0]) + moved)


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learns from about `sample` labelled rows of each class for which held_out is not true.

    held_out is an expression on labels. Labels other than 0 and 1 count for nothing; of several
    labels of one id the smallest holds. Class sizes are counted over all labels, the sample is
    drawn by hash, and only its documents leave their partitions, as hashed features; a document
    of over MOST_BUCKETS distinct buckets leaves those of the smallest hashes. Null texts teach the
    bias only, as empty ones do. Labels whose document is missing teach nothing. Without labels of
    both classes every text has one score, that of the class sizes. docs may hold other columns.
    """
    key, label = unused(docs, "labelled"), unused(docs, "label")
    usable = labels.where(~F.coalesce(held_out, F.lit(True)) & F.col(label_col).isin(0, 1))
    usable = materialise(usable.groupBy(F.col(id_col).alias(key)).agg(F.min(F.col(label_col).cast("int")).alias(label)))
    totals = {r[label]: r["count"] for r in usable.groupBy(label).count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    share = F.when(F.col(label) == 1, sample / max(n1, 1)).otherwise(sample / max(n0, 1))
    chosen = usable.where(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), key), 11) / F.lit(float(2**53)) < share)
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col(key)).select(F.col(label).alias("label"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_thinned(*packed(t)) for t in batch.column(1).to_pylist()]
            buckets = [b.astype("<u2").tobytes() for b, _ in own]
            weights = [w.tobytes() for _, w in own]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.binary()), pa.array(weights, pa.binary()), batch.column(0)], ["buckets", "weights", "label"])

    found = rows.mapInArrow(run, "buckets binary, weights binary, label int").toPandas()
    found = found.sort_values(["label", "buckets", "weights"], kind="stable")  # any order of partitions gives the same model
    learnt = [(np.frombuffer(b, "<u2").astype(np.int32), np.frombuffer(w, np.float32), int(y)) for b, w, y in found.itertuples(index=False)]
    return train(learnt, (n0, n1))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row of docs: whole texts, null as empty.

    A text without words gets the score of the bias alone. Rows are scored one by one, so
    repeated rows repeat and an empty table stays empty; other columns are not read.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), model.column(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose score reaches the threshold.

    Null and empty texts have the score of the bias alone. Repeated rows are judged alike, an
    empty table stays empty; columns of docs may have any names.
    """
    score = unused(docs, "score")
    return docs.withColumn(score, model.column(F.col(text_col))).where(F.col(score) >= threshold).select(*docs.columns)

"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

DIMENSIONS = 512
#: Letters bound into one n-gram vector.
GRAM = 3
#: About so many documents of each language are learnt from, drawn by hash of doc_id.
SAMPLE = 1000
#: n-gram vectors that a worker keeps.
KEPT = 1 << 15
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    if not _letters:
        _letters.append(np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.int64))
    return _letters[0]


class Encoder:
    """Bundles of bound, permuted letter vectors.

    Each letter has a random vector of -1 and 1 that its code point alone decides; an n-gram is
    the product of its letters' vectors, each rolled by its distance from the end. A text's
    profile is the sum over its n-grams, with runs of other characters as one boundary letter.
    """

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.row: dict[int, int] = {}
        self.kept = np.zeros((KEPT, dimensions), np.int8)
        self.rolled: dict[tuple[int, int], np.ndarray] = {}

    def letter(self, code: int, roll: int) -> np.ndarray:
        if (code, roll) not in self.rolled:
            if len(self.rolled) > 30_000:
                self.rolled.clear()
            drawn = np.random.Generator(np.random.PCG64(code)).integers(0, 2, self.dimensions, np.int8) * 2 - 1
            self.rolled[code, roll] = np.roll(drawn.astype(np.int8), roll)
        return self.rolled[code, roll]

    def gram(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for roll in range(GRAM):
            out = out * self.letter(code >> (21 * roll) & 0x1FFFFF, roll)
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the text's n-grams and how often each comes; none without a letter."""
        codes = _letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.r_[0, codes, 0]
        codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
        if len(codes) < GRAM:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        windows = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        return np.unique(windows, return_counts=True)

    def profile(self, text: str) -> np.ndarray | None:
        """The text's bundle, or None without letters."""
        codes, counts = self.grams(text)
        if not len(codes):
            return None
        out = np.zeros(self.dimensions, np.float32)
        for k in range(0, len(codes), 4096):
            part = codes[k : k + 4096].tolist()
            weights = counts[k : k + 4096].astype(np.float32)
            rows = [self.row.get(c, -1) for c in part]
            extra = []
            for i, r in enumerate(rows):
                if r < 0:
                    made = self.gram(part[i])
                    if len(self.row) < KEPT:
                        rows[i] = self.row[part[i]] = len(self.row)
                        self.kept[rows[i]] = made
                    else:
                        extra.append((i, made))
            found = np.array(rows)
            have = found >= 0
            out += weights[have] @ self.kept[found[have]].astype(np.float32)
            for i, made in extra:
                out += weights[i] * made
        return out


_encoders: dict[int, Encoder] = {}


def encoder(dimensions: int) -> Encoder:
    """One encoder for each Python worker."""
    if dimensions not in _encoders:
        _encoders[dimensions] = Encoder(dimensions)
    return _encoders[dimensions]


@dataclass(frozen=True)
class LanguageModel:
    """Unit prototypes, one row for each language, in order of their names."""

    languages: list[str]
    prototypes: np.ndarray = field(repr=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language whose prototype has the largest cosine (ties: the smaller name), and that
        cosine, not below 0; `und` and 0 without letters or languages."""
        profile = encoder(self.prototypes.shape[1]).profile(text) if text and self.languages else None
        if profile is None:
            return UNKNOWN, 0.0
        length = float(np.linalg.norm(profile))
        cosines = self.prototypes @ profile / length if length else np.zeros(len(self.languages))
        best = int(np.argmax(cosines))
        return self.languages[best], min(1.0, max(0.0, float(cosines[best])))


def fit_languages(docs: DataFrame, held_out: Column, sample: int = SAMPLE, dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Prototypes from about `sample` documents of each language for which held_out is not true.

    Languages are counted over all rows; the sample is drawn by hash of the id. Each task bundles
    its documents' unit profiles by language, and the bundles are added up in Spark, so that the
    driver gets one vector for each language. Null languages and texts without letters teach
    nothing.
    """
    usable = docs.where(~F.coalesce(held_out, F.lit(False)) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = materialise(usable.groupBy("lang").agg(F.count("*").alias("n")))
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(11), "_id", F.when(F.col("_id").isNull(), F.col("text"))), 11) / F.lit(float(2**53))
    chosen = usable.join(sizes, "lang").where(drawn * F.col("n") < sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                profile = encoder(dimensions).profile(text) if text else None
                if profile is not None and profile.any():
                    sums[lang] = sums.get(lang, 0) + profile.astype(np.float64) / np.linalg.norm(profile)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([np.round(total, 6).tolist()], pa.list_(pa.float64()))], ["lang", "bundle"])

    bundles = chosen.select("lang", "text").mapInArrow(run, "lang string, bundle array<double>")
    summed = bundles.select("lang", F.posexplode("bundle").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():
        found.setdefault(r["lang"], np.zeros(dimensions))[r["k"]] = r["x"]
    names = sorted(found)
    rows = [found[n] / (np.linalg.norm(found[n]) or 1.0) for n in names]
    return LanguageModel(names, np.array(rows, np.float32).reshape(len(names), dimensions))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, from the whole text alone.

    Null texts and texts without a letter get `und` and 0. Rows are judged one by one: repeated
    rows repeat, an empty table stays empty, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")

"""Near duplicates: SimHash fingerprints linked through vantage-point trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import components
from .shared import discard, materialise, unused

WORDS = 4
#: Fingerprints that differ in at most so many bits are linked.
RADIUS = 4
BITS = 64
#: Parts of the bits, each with trees of its own: two fingerprints within RADIUS are within
#: RADIUS // PARTS of one another in at least one of them.
PARTS = 3
#: Points of a leaf, and of a shard that is not cut into rings.
LEAF, SHARD_POINTS = 64, 1 << 17
#: Rounds of cutting; shards that are large then still are searched whole.
MOST_LEVELS = 64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash over shingles of `words` words, as a signed 64-bit number.

    A-Z become lower case; words are runs without ASCII white space. A bit is set if it is set
    in over half of the shingles' XXH64 (seed 42), repeats counted. A text of fewer words is one
    shingle; one without words, or null, has fingerprint 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(parts) - words + 1)].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


class _Unions:
    """Union-find over 0..n-1 in whole arrays; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        root = self.up[i]
        while True:
            further = self.up[root]
            if np.array_equal(further, root):
                self.up[i] = root
                return root
            root = further

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def part_masks(parts: int = PARTS) -> list[int]:
    ends = [-(-BITS * k // parts) for k in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]


def vantage_links(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, mask: int = (1 << BITS) - 1, bound: int | None = None, count: Counter | None = None) -> np.ndarray:
    """For distinct fingerprints, the index of the first member of each one's component.

    Linked are those within `radius`, as far as they are within `bound` on the bits of mask too
    (by default all bits, and no further bound). The points are split at the median Hamming
    distance, on these bits, from a vantage point, again and again; a query goes down a branch
    only if its own distance is within `bound` of the distances found there (triangle bound).
    All queries go down together, so each node is met once. Queries that are in the one component
    of a branch already are left out; that keeps dense groups from being compared pair by pair.
    `count` is told how many nodes were cut, and how many queries went down or were pruned there.
    """
    n, unions = len(points), _Unions(len(points))
    bound = radius if bound is None else bound
    seen = points & np.uint64(mask)
    count = Counter() if count is None else count

    def compare(queries: np.ndarray, own: np.ndarray) -> None:
        for k in range(0, len(queries), 8192):
            q = queries[k : k + 8192]
            near = np.bitwise_count(points[q][:, None] ^ points[own][None, :]) <= radius
            hit = near.any(axis=1)
            if not hit.any():
                continue
            near, q = near[hit], q[hit]
            unions.link(q, own[near.argmax(axis=1)])
            shared = np.argwhere(np.triu(near.T.astype(np.float32) @ near.astype(np.float32) > 0, 1))
            unions.link(own[shared[:, 0]], own[shared[:, 1]])

    todo = [(np.arange(n), np.arange(n))]
    while todo:
        own, queries = todo.pop()
        roots = unions.find(own)
        if len(own) and (roots == roots[0]).all():
            queries = queries[unions.find(queries) != roots[0]]
        if not len(queries):
            continue
        if len(own) <= leaf:
            count["leaves"] += 1
            compare(own, own)
            roots = unions.find(own)
            if (roots == roots[0]).all():
                queries = queries[unions.find(queries) != roots[0]]
            compare(queries, own)
            continue
        at = own[len(own) // 2]
        d_own, d = np.bitwise_count(seen[own] ^ seen[at]).astype(np.int16), np.bitwise_count(seen[queries] ^ seen[at]).astype(np.int16)
        middle = np.partition(d_own, len(own) // 2)[len(own) // 2]
        inner = d_own <= middle
        if inner.all():
            inner = d_own < middle
        if not inner.any():  # all at one distance: no cut helps
            for k in range(0, len(own), leaf):
                todo.append((own[k : k + leaf], queries))
            continue
        count["cuts"] += 1
        for side in (inner, ~inner):
            asked = (d >= d_own[side].min() - bound) & (d <= d_own[side].max() + bound)
            count["asked"] += int(asked.sum())
            count["pruned"] += int(len(asked) - asked.sum())
            todo.append((own[side], queries[asked]))
    return unions.find(np.arange(n))


def _linker(radius: int):
    """Links (a, b) of shards that stand one after the other, sorted by shard."""
    masks = part_masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links(shards: np.ndarray, parts: np.ndarray, points: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shards)], strict=True):
                own = points[a:b]
                roots = vantage_links(own, radius, LEAF, masks[parts[a]], radius // PARTS)
                linked = roots != np.arange(len(own))
                if linked.any():
                    yield pa.RecordBatch.from_arrays([pa.array(own[linked].view(np.int64)), pa.array(own[roots[linked]].view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)))
            if held[0][0][0] == held[-1][0][-1] or sum(len(x[0]) for x in held) < SHARD_POINTS:
                continue
            columns = list(map(np.concatenate, zip(*held, strict=True)))
            cut = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1  # the last shard may go on
            yield from links(*(c[:cut] for c in columns))
            held = [tuple(c[cut:] for c in columns)]
        if held:
            yield from links(*map(np.concatenate, zip(*held, strict=True)))

    return run


def shards(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """shard, part, fp: for each part of the bits each fingerprint (column fp, distinct) in one
    shard or more, so that two within `radius` meet in a shard of a part on which they are close.

    A shard of over shard_points points is cut into rings by distance, on the bits of its part,
    from a vantage point, one of its points. A ring is as wide as the distance of a close pair and
    one more, so such a pair is in one ring or in two that touch; the points of a ring near its
    inner boundary are in the ring below too. Rings that are too large are cut again around
    points of their own, each round for all shards at once. Where the part's bits say no more,
    distances on all bits do; what even those cannot cut lies within 2 * radius bits of a point,
    of which there are only so many (under a million for a radius of 4).
    """
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in part_masks()]
    bound = radius // PARTS
    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("part") + 1)
    rows = points.select(F.explode(F.array(*[F.lit(k) for k in range(PARTS)])).alias("part"), "fp")
    rows = materialise(rows.select(F.xxhash64("part").alias("shard"), "part", F.lit(False).alias("done"), "fp"))
    for level in range(MOST_LEVELS):
        draw = F.xxhash64("fp", F.lit(level))
        sizes = rows.where("not done").groupBy("shard").agg(F.count("*").alias("n"), F.min_by("fp", draw).alias("vantage"))
        large = materialise(sizes.where(F.col("n") > shard_points).select("shard", "vantage"))
        if large.isEmpty():
            discard(large)
            break
        unlike = F.col("fp").bitwiseXOR(F.col("vantage"))
        met = rows.join(large, "shard", "left").withColumns({"all": F.bit_count(unlike), "own": F.bit_count(unlike.bitwiseAND(mask))})
        far = materialise(met.where("vantage is not null").groupBy("shard").agg((F.max("own") > 2 * bound).alias("by_part"), (F.max("all") > 2 * radius).alias("by_all")))
        met = met.join(far, "shard", "left")
        reach = F.when(F.col("by_part"), bound).otherwise(radius)
        d = F.when(F.col("by_part"), F.col("own")).otherwise(F.col("all"))
        ring = lambda x: F.floor(x / (reach + 1))  # noqa: B023, E731
        rings = F.array_distinct(F.array(ring(d), ring(F.greatest(d - reach, F.lit(0)))))
        cut = F.col("by_part") | F.col("by_all")
        at = F.when(cut, F.transform(rings, lambda r: F.xxhash64("shard", F.lit(level), r))).otherwise(F.array("shard"))
        new = materialise(met.select(F.explode(at).alias("shard"), "part", (F.col("done") | F.coalesce(~cut, F.lit(False))).alias("done"), "fp"))
        for table in (rows, large, far):
            discard(table)
        rows = new
    return rows.select("shard", "part", "fp")


def link_fingerprints(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """a, b: links that join exactly the fingerprints (column fp, distinct) within `radius`.

    Not every pair is listed, but two fingerprints are connected through these links if and
    only if they are connected through pairs that differ in at most `radius` bits. Shards by
    distance from vantage points (see shards()) hold every such pair; in each shard a
    vantage-point tree finds the exact pairs (see vantage_links()).
    """
    dealt = shards(points, radius, shard_points).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_linker(radius), "a long, b long")


def _member_components(prints: DataFrame, radius: int) -> DataFrame:
    """fp, first: the smallest member of the component of each fingerprint in prints (fp, member)."""
    points = materialise(prints.groupBy("fp").agg(F.min("member").alias("first")))
    roots = components(materialise(link_fingerprints(points.select("fp"), radius)))
    roots = materialise(roots.select(F.col("node").alias("fp"), "root"))
    linked = materialise(points.join(roots, "fp"))
    firsts = materialise(linked.groupBy("root").agg(F.min("first").alias("first")))
    own = linked.select("fp", "root").join(firsts, "root").select("fp", "first")
    alone = points.join(roots.select("fp"), "fp", "left_anti").select("fp", "first")
    return materialise(own.unionAll(alone))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links of at most `radius`
    differing bits, itself included. Equal fingerprints are one point, so copies cost one row
    each. Null texts, and texts without words, have fingerprint 0 and are linked like any other.
    Null ids are never the smallest; a component of null ids only has a null component_id. No
    rows in, no rows out; other columns are not read.
    """
    prints = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col).cast("string")).alias("fp")))
    found = _member_components(prints.select("fp", F.col("doc_id").alias("member")), radius)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row (by doc_id, null last) of each component, with all columns of docs.

    Components are those of near_duplicates(): null and empty texts have fingerprint 0 and are
    linked like any other. Of rows that repeat an id within a component exactly one stays. An
    empty table gives none; columns of docs may have any names.
    """
    fp, row = unused(docs, "fp"), unused(docs, "row")
    rows = materialise(docs.withColumns({fp: fingerprint_udf(F.col(text_col).cast("string")), row: F.monotonically_increasing_id()}))
    member = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = _member_components(rows.select(F.col(fp).alias("fp"), member.alias("member")), radius)
    keep = found.select(F.col("first.row").alias(row)).distinct()
    return rows.join(keep, row, "left_semi").select(*docs.columns)

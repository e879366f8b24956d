"""Approximate nearest neighbours: a small-world graph for each shard, results merged."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialise

#: Links of a node above layer 0 (twice as many in layer 0), candidates while building and searching.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 48, 144
#: Distinct vectors of a shard, and queries that meet a shard together, about.
SHARD_ROWS, BLOCK_QUERIES = 16_384, 32_768
#: A query asks the shards of its PROBES nearest cells. Where there are more cells, each vector stands
#: in its COPIES nearest ones, so that a query beside a border finds what lies behind it.
PROBES, COPIES = 32, 3
#: Cells at most, and sampled vectors for each of them that their centres are fitted on.
MOST_CELLS, SAMPLE = 4096, 32
SEED = 5


def _chosen(ids: np.ndarray, away: np.ndarray, most: int, brief: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Which of each row's candidates (nearest first, -1 where there is none) become links: those
    nearer to the row's node than to one another, then the nearest others, `most` in all."""
    own = brief[ids]
    between = norms[ids][:, :, None] + norms[ids][:, None, :] - 2 * (own @ own.transpose(0, 2, 1))
    there = ids >= 0
    nearest, chosen, n = np.full(ids.shape, np.inf, np.float32), np.zeros(ids.shape, bool), np.zeros(len(ids), int)
    for k in range(ids.shape[1]):
        good = there[:, k] & (n < most) & (nearest[:, k] > away[:, k])
        chosen[:, k], n = good, n + good
        nearest[good] = np.minimum(nearest[good], between[good, k])
    others = there & ~chosen
    return chosen | (others & (np.cumsum(others, axis=1) <= (most - n)[:, None]))


class SmallWorld:
    """Hierarchical navigable small-world graph over the rows of `vectors`.

    Neighbours stand in flat arrays, one for each layer: row i of layer l has the links of node
    i, filled from the left, -1 behind. Distances are squared Euclidean, in double precision.
    """

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry
        self.norms = (vectors * vectors).sum(axis=1)
        self.seen = np.zeros(len(vectors), np.int64)
        self.mark = 0

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = SEED) -> SmallWorld:
        """The graph, block by block: each block doubles the nodes, and its nodes choose their links
        among all there are then, so that early ones keep long links, as if nodes came singly."""
        n = len(vectors)
        heights = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(LINKS)).astype(int), 12)
        heights[0] = heights.max()
        self = cls(vectors, [np.full((n, LINKS * (1 if k else 2)), -1, np.int32) for k in range(heights.max() + 1)], 0)
        brief = vectors.astype(np.float32)
        norms = (brief * brief).sum(axis=1)
        for layer, links in enumerate(self.layers):
            members = np.flatnonzero(heights >= layer)
            known = 1
            while known < len(members):
                end = min(len(members), max(2 * known, BUILD_WIDTH))
                for k in range(known, end, 512):
                    self._link(members[k : min(k + 512, end)], members[:end], links, brief, norms)
                known = end
        return self

    @staticmethod
    def _link(new: np.ndarray, known: np.ndarray, links: np.ndarray, brief: np.ndarray, norms: np.ndarray) -> None:
        """Gives each new node its links among the known ones, and those their links back."""
        away = norms[known][None, :] + norms[new][:, None] - 2 * (brief[new] @ brief[known].T)
        away[new[:, None] == known[None, :]] = np.inf
        width = min(BUILD_WIDTH, len(known) - 1)
        near = np.argpartition(away, width - 1, axis=1)[:, :width]
        found = np.take_along_axis(away, near, axis=1)
        order = found.argsort(axis=1, kind="stable")
        found, near = np.take_along_axis(found, order, axis=1), known[np.take_along_axis(near, order, axis=1)]
        row, k = np.nonzero(_chosen(near, found, LINKS, brief, norms))
        to, back, d = near[row, k], new[row], found[row, k]
        # all links that end in or leave a touched node, nearest first
        touched = np.unique(np.r_[to, back])
        old_row, old_k = np.nonzero(links[touched] >= 0)
        old_from, old_to = touched[old_row], links[touched][old_row, old_k].astype(np.int64)
        old_d = norms[old_from] + norms[old_to] - 2 * np.einsum("ij,ij->i", brief[old_from], brief[old_to])
        start, stop, length = np.r_[old_from, back, to], np.r_[old_to, to, back], np.r_[old_d, d, d]
        order = np.lexsort((stop, length, start))
        start, stop, length = start[order], stop[order], length[order]
        once = np.unique(np.stack([start, stop]), axis=1, return_index=True)[1]
        once.sort()
        start, stop, length = start[once], stop[once], length[once]
        first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
        sizes = np.diff(np.r_[first, len(start)])
        most, place = links.shape[1], np.arange(len(start)) - np.repeat(first, sizes)
        kept = place < BUILD_WIDTH
        wide = int(min(sizes.max(), BUILD_WIDTH))
        ids, lengths = np.full((len(first), wide), -1), np.full((len(first), wide), np.inf, np.float32)
        at = np.repeat(np.arange(len(first)), sizes)[kept], place[kept]
        ids[at], lengths[at] = stop[kept], length[kept]
        full = np.flatnonzero(sizes > most)
        chosen = ids >= 0
        for k in range(0, len(full), 512):
            part = full[k : k + 512]
            chosen[part] = _chosen(ids[part], lengths[part], most, brief, norms)
        row, k = np.nonzero(chosen)
        out = np.full((len(first), most), -1, np.int32)
        out[row, (np.cumsum(chosen, axis=1) - 1)[row, k]] = ids[row, k]
        links[start[first]] = out

    def _distances(self, query: np.ndarray, length: float, ids: np.ndarray) -> np.ndarray:
        return self.norms[ids] + length - 2 * (self.vectors[ids] @ query)

    def _walk(self, query: np.ndarray, starts: list[tuple[float, int]], layer: int, width: int) -> list[tuple[float, int]]:
        """The `width` nearest found from the starts, nearest first."""
        links, length = self.layers[layer], float(query @ query)
        self.mark += 1
        seen, mark = self.seen, self.mark
        seen[[i for _, i in starts]] = mark
        todo = sorted(starts)
        best = sorted((-d, i) for d, i in starts)[-width:]
        while todo:
            d, i = heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            around = links[i]
            around = around[(around >= 0) & (seen[around] != mark)]
            if not len(around):
                continue
            seen[around] = mark
            found = self._distances(query, length, around)
            if len(best) >= width:
                near = found < -best[0][0]
                around, found = around[near], found[near]
            for d, i in zip(found.tolist(), around.tolist(), strict=True):
                if len(best) < width:
                    heappush(best, (-d, i))
                elif d < -best[0][0]:
                    heapreplace(best, (-d, i))
                else:
                    continue
                heappush(todo, (d, i))
        return sorted((-d, i) for d, i in best)

    def search(self, query: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Rows of about the k nearest; fewer only if there are fewer."""
        n = len(self.vectors)
        at = [(float(self._distances(query, float(query @ query), np.array([self.entry]))[0]), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._walk(query, at, layer, 1)
        found = self._walk(query, at, 0, max(width, k))
        out = np.array([i for _, i in found], np.int64)
        return out if len(out) >= k else np.arange(n)

    def to_row(self) -> dict:
        return {"layers": [x.tobytes() for x in self.layers], "vectors": self.vectors.tobytes(), "entry": self.entry, "n": len(self.vectors)}

    @classmethod
    def from_row(cls, row: dict) -> SmallWorld:
        n = row["n"]
        return cls(np.frombuffer(row["vectors"], np.float64).reshape(n, -1), [np.frombuffer(x, np.int32).reshape(n, -1) for x in row["layers"]], row["entry"])


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _rows(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    found = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return found.where(F.col("id").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False)))


def _centres(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centres of `cells` cells by k-means on the sample."""
    if cells == 1:
        return sample.mean(axis=0, keepdims=True)
    out = sample[np.sort(np.random.default_rng(SEED).choice(len(sample), cells, replace=False))]
    for _ in range(rounds):
        at = np.concatenate([_nearest(out, sample[k : k + 4096], 1)[:, 0] for k in range(0, len(sample), 4096)])
        n = np.bincount(at, minlength=cells)
        sums = np.zeros_like(out)
        np.add.at(sums, at, sample)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
    return out


def _nearest(centres: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest cells of each vector, nearest first."""
    away = (centres * centres).sum(axis=1)[None, :] - 2 * (vectors @ centres.T)
    return np.argsort(away, axis=1, kind="stable")[:, :k]


class Cells:
    """Centres of the cells of each number of dimensions, and into how many shards a cell is split."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres, self.shards = centres, {}

    def deal(self, table: DataFrame, copies: int) -> DataFrame:
        """table (with dim and vector) with cell: a row for each of the `copies` nearest cells."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.array(batch.column("dim"))
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    part = batch.take(pa.array(rows))
                    vectors = part.column("vector").flatten().to_numpy().reshape(len(rows), dim)
                    cells = _nearest(centres[dim], vectors, copies)
                    again = part.take(pa.array(np.repeat(np.arange(len(rows)), cells.shape[1])))
                    yield pa.RecordBatch.from_arrays([*again.columns, pa.array(cells.reshape(-1).astype(np.int32))], [*again.schema.names, "cell"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
        return table.mapInArrow(run, f"{kinds}, cell int")


def build_index(rows: DataFrame, keep: int, shard_rows: int = SHARD_ROWS, probes: int = PROBES, copies: int = COPIES) -> tuple[DataFrame, Cells]:
    """shard, dim, cell, ids and the graph, one row for each shard of rows (id, vector); and the cells.

    Equal vectors are one node with the `keep` smallest of their ids: no query can want more.
    Those are found by a ranking that starts before the shuffle. Nodes go to the cell of the
    nearest centre, for each number of dimensions apart, and if there are more than `probes` cells
    to their `copies` nearest ones. Centres are fitted on a sample drawn by hash, SAMPLE vectors a
    cell; every row is indexed. There is a cell for about shard_rows nodes, up to MOST_CELLS; a
    cell with more than twice as many is split into shards by hash, which are asked together.
    No rows, no shards.
    """
    once = W.partitionBy("vector").orderBy("id")
    ranked = rows.distinct().withColumn("_n", F.row_number().over(once)).where(F.col("_n") <= keep).drop("_n")
    nodes = materialise(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("vector")))
    counts = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}
    wanted = {dim: min(MOST_CELLS, max(1, math.ceil(n / shard_rows))) for dim, n in counts.items()}
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "vector"), 11) / F.lit(float(2**53))
    centres = {}
    for dim, cells in wanted.items():
        share = min(1.0, 2.0 * SAMPLE * cells / counts[dim])
        near = nodes.where((F.col("dim") == dim) & (drawn < share)).orderBy(drawn).limit(SAMPLE * cells).select("vector").collect()
        centres[dim] = _centres(np.array([r["vector"] for r in near], np.float64), min(cells, len(near)))
    cells = Cells(centres)
    many = copies if any(len(c) > probes for c in centres.values()) else 1
    dealt = materialise(cells.deal(nodes, many))
    sizes = {(r["dim"], r["cell"]): r["count"] for r in dealt.groupBy("dim", "cell").count().collect()}  # a number for each cell
    cells.shards = {key: max(1, math.ceil(n / (2 * shard_rows))) for key, n in sizes.items()}
    split = F.lit(1)
    for (dim, cell), n in cells.shards.items():
        if n > 1:
            split = F.when((F.col("dim") == dim) & (F.col("cell") == cell), n).otherwise(split)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vector"), split).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda s: s.map(lambda x: int(x[0])))
        row = SmallWorld.build(np.array(part["vector"].tolist(), np.float64)).to_row()
        ids = [np.asarray(x, np.int64) for x in part["ids"]]
        ends = np.cumsum([0, *map(len, ids)])
        key = {k: part[k].iloc[0] for k in ("dim", "cell", "shard")}
        return pd.DataFrame([{**key, "n": row["n"], "entry": row["entry"], "ends": ends.tobytes(), "ids": np.concatenate(ids).tobytes(), "vectors": row["vectors"], "layers": row["layers"]}])

    schema = "dim int, cell int, shard int, n int, entry int, ends binary, ids binary, vectors binary, layers array<binary>"
    groups = ["dim", "cell", "shard"]
    # a task for each shard: their bytes say little about how long they take
    apart = dealt.repartition(2 * max(1, sum(cells.shards.values())), *groups)
    return materialise(apart.groupBy(*groups).applyInPandas(build, schema)), cells


def search_index(index: DataFrame, cells: Cells, queries: DataFrame, k: int, width: int = SEARCH_WIDTH, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query (id, vector).

    A query goes to the shards of its `probes` nearest cells; a shard answers with k rows at most
    for each query, and the answers are merged, each row once. Distances are computed anew in
    double precision from the original vectors. The row of the query's own id is left out. Queries
    of a number of dimensions that the index lacks find nothing; no queries, no rows.
    """
    asked = queries.distinct().withColumns({"dim": F.size("vector"), "query": F.xxhash64("vector")}).where(F.col("dim").isin([int(d) for d in cells.centres]))
    dealt = materialise(cells.deal(asked, probes))
    most = dealt.groupBy("dim", "cell").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, math.ceil(most / BLOCK_QUERIES))
    groups = ["dim", "cell", "block"]
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(right):
            return pd.DataFrame([], columns=["query_id", "query", "score", "vec_id"])
        for row in left.to_dict("records"):
            graph = SmallWorld.from_row(row)
            ends, ids = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["ids"], np.int64)
            for own, query, vector in zip(right["id"], right["query"], right["vector"], strict=True):
                nodes = graph.search(np.asarray(vector, np.float64), k + 1, width)
                away = graph.vectors[nodes] - np.asarray(vector, np.float64)
                scores = np.sqrt((away * away).sum(axis=1))
                found = sorted((s, i) for s, at in zip(scores.tolist(), nodes.tolist(), strict=True) for i in ids[ends[at] : ends[at + 1]].tolist() if i != own)
                out += [(own, query, s, i) for s, i in found[:k]]
        return pd.DataFrame(out, columns=["query_id", "query", "score", "vec_id"])

    tasks = 2 * max(1, blocks * sum(cells.shards.values()))
    pairs = held.repartition(tasks, *groups).groupBy(*groups).cogroup(dealt.repartition(tasks, *groups).groupBy(*groups))
    answers = pairs.applyInPandas(search, "query_id long, query long, score double, vec_id long").distinct()
    merged = W.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH, probes: int = PROBES, copies: int = COPIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For the rows for which is_query holds, their k nearest among all rows but those of their own id.

    Rows with a null id take no part, nor do vectors that are null, zero, or hold null or
    non-finite components. Rows that repeat id and vector are one; vectors that share an id are
    rows of their own, asked one by one. Vectors are compared with those of as many dimensions
    only. With fewer than k candidates all are returned, unless they lie in cells that a query does
    not ask; no queries, no rows.
    """
    rows = materialise(_rows(table, id_col, vector_col))
    queries = materialise(_rows(table.where(is_query), id_col, vector_col))
    index, cells = build_index(rows, k + 1, shard_rows, probes, copies)
    return search_index(index, cells, queries, k, width, probes)

"""Reach, components and communities of directed links."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

TRACE_DEPTH = 6
#: Tasks for each core that traces are dealt to (each holds the links of the projects it traces), and nodes of a row.
DEALS, ROW_NODES = 1, 4096
MOST_ROUNDS = 200


def _spread(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes met from a frontier (project, start, node): rows project, start, node, depth; until nothing new is met.

    One join for each level; what was met before is left out by an anti join, so cycles end, and
    every level is written before the next, so the plan does not grow with the depth.
    """
    links = links.select("project", F.col("a").alias("node"), F.col("b").alias("next")).distinct()
    seen = cut(frontier.select("project", "start", "node").withColumn("depth", F.lit(0)).limit(0))
    for depth in count(1):
        met = frontier.join(links, ["project", "node"]).select("project", "start", F.col("next").alias("node")).distinct()
        met = cut(met.join(seen, ["project", "start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if met.isEmpty():
            break
        seen = cut(seen.unionByName(met))
        frontier = met.select("project", "start", "node")
    return seen


def _reached(start: int, ends: np.ndarray, to: np.ndarray, ports: np.ndarray, depth: int) -> list[np.ndarray]:
    """What is met from a start at each level for the first time; links of node n are to[ends[n]:ends[n + 1]]."""
    seen, levels = np.zeros(len(ports), bool), []
    frontier = np.array([start])
    for _ in range(depth):
        sizes = ends[frontier + 1] - ends[frontier]
        met = np.zeros(len(ports), bool)
        met[to[np.repeat(ends[frontier] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]] = True
        met &= ~seen
        seen |= met
        found = np.flatnonzero(met)
        if not len(found):
            break
        levels.append(found)
        frontier = found[~ports[found]]
    return levels


def _traced(batches: Iterator[pa.RecordBatch], depth: int, named: bool) -> Iterator[pa.RecordBatch]:
    """Levels of the traces of rows (project, n, id, kind, port, start, after) in order of their project:
    a row for each start, depth, port or not and kind, with the nodes' names in pieces of ROW_NODES."""
    names = ["project", "start", "depth", "is_port", "kind", "nodes"]

    def run(project: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by("n")
        known, after = table["n"].to_numpy(), table["after"].combine_chunks()
        to = np.searchsorted(known, after.flatten().to_numpy())
        ends = np.r_[0, np.cumsum(after.value_lengths().fill_null(0).to_numpy())]
        ports, starts = (table[c].to_numpy(zero_copy_only=False) for c in ("port", "start"))
        ids, kinds = table["id"].combine_chunks(), table["kind"].combine_chunks().dictionary_encode()
        labels = 2 * kinds.indices.to_numpy() + ports
        for s in np.flatnonzero(starts).tolist():
            rows = []
            for k, level in enumerate(_reached(s, ends, to, ports, depth), 1):
                level = level[np.argsort(labels[level], kind="stable")]
                cuts = np.flatnonzero(np.diff(labels[level], prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(level)], strict=True):
                    rows += [(k, level[x : min(x + ROW_NODES, b)]) for x in (range(a, b, ROW_NODES) if named else (a,))]
            if not rows:
                continue
            first = np.array([x[0] for _, x in rows])
            if named:
                own = pa.ListArray.from_arrays(np.cumsum([0, *(len(x) for _, x in rows)]).astype(np.int32), ids.take(pa.array(np.concatenate([x for _, x in rows]))))
            else:
                own = pa.nulls(len(rows), pa.list_(pa.string()))
            texts = [pa.array([project] * len(rows), pa.string()), pa.array([ids[s].as_py()] * len(rows), pa.string())]
            yield pa.RecordBatch.from_arrays([*texts, pa.array([k for k, _ in rows], pa.int32()), pa.array(ports[first]), kinds.dictionary.take(pa.array(labels[first] // 2)), own], names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            project, column = batch.column(0)[at].as_py(), batch.column(0)
            if held and held[0].column(0)[0].as_py() != project:
                yield from run(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))
                held = []
            ahead = pc.index(pc.not_equal(column[at:], project), True).as_py()
            end = batch.num_rows if ahead < 0 else at + ahead
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield from run(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))


def _numbered(nodes: DataFrame) -> DataFrame:
    """nodes, written, with n: the rows numbered from 0."""
    nodes = cut(nodes.withColumn("_at", F.monotonically_increasing_id()))
    part, offsets, total = F.shiftright("_at", 33), [], 0
    for r in sorted(nodes.groupBy(part.alias("part")).count().collect()):
        offsets.append((r[0], total))
        total += r[1]
    before = nodes.sparkSession.createDataFrame(offsets, "part long, before long")
    own = nodes.withColumn("part", part).join(F.broadcast(before), "part")
    return own.withColumn("n", (F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int")).drop("part", "before", "_at")


def trace(entries: DataFrame, links: DataFrame, stations: DataFrame, ports: DataFrame, depth: int = TRACE_DEPTH, carried: str | None = None, named: bool = True) -> DataFrame:
    """project, start, node, depth, is_port: what each entry (project, id) reaches.

    Links are (project, a, b); only nodes in stations (project, id) are met; a port is met but
    not passed. The start is not among what was seen, so a cycle back to it is a hop. With
    `carried`, a column of stations, a hop has that of its node, and there is a hop for each
    station of one id; without `named` there is no node, but a row for each other value.

    Nodes are numbered, and a task holds the links of a project while it walks from its share of the
    entries, so that nothing is written that grows with the hops.
    """
    spark = entries.sparkSession
    key = ["project", "id"]
    kind = F.to_json(F.sort_array(F.collect_list(F.struct(F.col(carried).alias("v"))))) if carried else F.lit("")
    known = stations.where("id is not null").groupBy(*key).agg(kind.alias("kind"), F.lit(True).alias("station"))
    known = known.join(ports.select(*key, F.lit(True).alias("port")).distinct(), key, "left")
    starts = entries.where("id is not null").select(*key, F.lit(True).alias("start")).distinct()
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    nodes = _numbered(known.join(starts, key, "full_outer").select(*key, F.coalesce("kind", F.lit("")).alias("kind"), *map(no, ("station", "port", "start"))))
    number = lambda end, c: nodes.where(c).select("project", F.col("id").alias(end), F.col("n").alias(f"n_{end}"))
    met = links.select("project", "a", "b").join(number("b", "station"), ["project", "b"]).join(number("a", "station or start"), ["project", "a"])
    after = met.groupBy("project", F.col("n_a").alias("n")).agg(F.collect_set("n_b").alias("after"))
    graph = cut(nodes.join(after, ["project", "n"], "left"))
    # a project's share of the tasks follows the links and entries that it has
    tasks = max(1, DEALS * spark.sparkContext.defaultParallelism)
    work = graph.groupBy("project").agg(F.count_if("start").alias("starts"), (F.count_if("start") * (F.sum(F.greatest(F.size("after"), F.lit(0))) + 1)).cast("double").alias("work")).where("starts > 0")
    every = work.agg(F.sum("work").alias("all"))
    share = F.least(F.col("starts"), F.ceil(F.col("work") / F.col("all") * tasks)).cast("int")
    dealt = work.crossJoin(F.broadcast(every)).select("project", F.least(share, F.lit(tasks)).alias("share"))
    copies = graph.join(dealt, "project").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("share") - 1)))
    copies = copies.withColumn("start", F.col("start") & (F.pmod("n", "share") == F.col("k")))
    copies = copies.repartitionById(tasks, F.pmod(F.hash("project").cast("long") + F.col("k"), F.lit(tasks)).cast("int"))
    own = copies.select("project", "n", "id", "kind", "port", "start", "after").sortWithinPartitions("project")
    found = own.mapInArrow(lambda batches: _traced(batches, depth, named), "project string, start string, depth int, is_port boolean, kind string, nodes array<string>")
    out = ["project", "start", "depth", "is_port"]
    if carried:
        of = stations.schema[carried].dataType.simpleString()
        found = found.withColumn("v", F.explode(F.from_json("kind", f"array<struct<v:{of}>>"))).withColumn(carried, F.col("v.v"))
        out.append(carried)
    if named:
        return found.select(*out, F.explode("nodes").alias("node")).select("project", "start", "node", *out[2:])
    return found.select(*out)


def dependents_of(changed: DataFrame, links: DataFrame) -> DataFrame:
    """project, node, depth: who depends on the changed nodes (project, id), directly (1) or not."""
    start = changed.select("project", F.lit("").alias("start"), F.col("id").alias("node"))
    back = links.select("project", F.col("b").alias("a"), F.col("a").alias("b"))
    found = _spread(start, back)
    return found.join(changed.select("project", F.col("id").alias("node")), ["project", "node"], "left_anti").select("project", "node", "depth")


def components(links: DataFrame) -> DataFrame:
    """project, node, root: connected components of undirected links (project, a, b).

    Each round every node takes the smallest label among itself and its neighbours, and then its
    label's label; rounds are logarithmic on chains.
    """
    both = cut(links.select("project", "a", "b").unionByName(links.select("project", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("project", F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "b"), ["project", "b"]).groupBy("project", F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, ["project", "node"]).select("project", "node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        jump = labels.select("project", F.col("node").alias("root"), F.col("root").alias("further"))
        new = cut(step.join(jump, ["project", "root"], "left").select("project", "node", "before", F.least("root", F.coalesce("further", "root")).alias("root")))
        labels = new.select("project", "node", "root")
        if new.where("before != root").isEmpty():
            return labels
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")


def modularity(weights: DataFrame, communities: DataFrame) -> DataFrame:
    """project, q of a partition: weights (project, a, b, w), a < b; communities (project, node, community)."""
    of = lambda end: communities.select("project", F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    placed = weights.join(of("a"), ["project", "a"]).join(of("b"), ["project", "b"])
    ends = placed.select("project", F.explode(F.array(F.struct(F.col("c_a").alias("c"), "w"), F.struct(F.col("c_b").alias("c"), "w"))).alias("x")).groupBy("project", "x.c").agg(F.sum("x.w").alias("d"))
    inside = placed.where("c_a = c_b").groupBy("project", F.col("c_a").alias("c")).agg(F.sum("w").alias("l"))
    m = weights.groupBy("project").agg(F.sum("w").alias("m"))
    share = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return ends.join(inside, ["project", "c"], "left").join(m, "project").groupBy("project").agg(F.sum(share).alias("q"))


def greedy_communities(nodes: list, weights: dict[tuple, float]) -> dict:
    """Communities by greedy merging: the pair with the largest gain first, ties to the smallest.

    A merge of linked x and y gains w / m - d_x d_y / (2 m^2); the merged community keeps the
    smaller name; it ends when no gain exceeds 1e-12. Links of a node to itself count for nothing.
    Memory grows with the links: gains wait in a heap, and one that was made before either of
    its ends grew is passed over.
    """
    near: dict = {n: {} for n in sorted(nodes)}
    for (a, b), w in weights.items():
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + w
    degree = {n: sum(x.values()) for n, x in near.items()}
    total = sum(degree.values()) / 2
    into = {n: n for n in near}
    if not total:
        return into
    grown = dict.fromkeys(near, 0)
    heap: list[tuple] = []

    def offer(a, b) -> None:
        a, b = min(a, b), max(a, b)
        gain = near[a][b] / total - degree[a] * degree[b] / (2 * total * total)
        if gain > 1e-12:
            heappush(heap, (-gain, a, b, grown[a], grown[b]))

    for a, others in near.items():
        for b in others:
            if a < b:
                offer(a, b)
    while heap:
        _, x, y, of_x, of_y = heappop(heap)
        if of_x != grown[x] or of_y != grown[y]:
            continue
        for other, w in near.pop(y).items():
            del near[other][y]
            if other != x:
                near[x][other] = near[other][x] = near[x].get(other, 0.0) + w
        degree[x] += degree.pop(y)
        into[y] = x
        grown[x], grown[y] = grown[x] + 1, -1
        for other in near[x]:
            offer(x, other)

    def end(n):
        while into[n] != n:
            into[n] = into[into[n]]
            n = into[n]
        return n

    return {n: end(n) for n in into}


def communities(weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, community for weights (keys, a, b, w): one small graph for each key."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = {(a, b): float(w) for a, b, w in zip(part["a"], part["b"], part["w"], strict=True) if a != b}
        nodes = sorted({n for pair in zip(part["a"], part["b"], strict=True) for n in pair})
        label = greedy_communities(nodes, found)
        return pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, "node": nodes, "community": [label[n] for n in nodes]})

    kinds = ", ".join(f"{k} {weights.schema[k].dataType.simpleString()}" for k in keys)
    node = weights.schema["a"].dataType.simpleString()
    return weights.groupBy(*keys).applyInPandas(run, f"{kinds}, node {node}, community {node}")

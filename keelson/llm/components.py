"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Rounds grow with the logarithm of the longest chain; beyond this something is wrong.
MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the smallest of u and its neighbours.

    The table of minima is written first, so that the join is one of two plain tables: small, it
    is broadcast; large, its hot keys are split by adaptive execution.
    """
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return pairs.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node that has a link to another, with the smallest node it can reach.

    Null ends and links of a node to itself count for nothing; repeated links count once. No
    links, no rows. Each round is two joins on the links that remain, never a pairing within
    a component, and is written to the shared folder.
    """
    x, y = F.col(a), F.col(b)
    edges = materialise(links.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        now = _state(edges)
        if now == before or not now[0]:
            break
        before = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = materialise(_star(both).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        small = _star(down).select(F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        edges = materialise(small.select("e.*").where("hi != lo").distinct())
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)

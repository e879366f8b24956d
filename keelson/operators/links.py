"""Module links, extern roll-up and lookups by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extern_key


def first_by_id(symbols: DataFrame, key: str = "id") -> DataFrame:
    """One row for each id: the first in scan order (what a point lookup sees)."""
    return _one(symbols, key, F.min_by)


def last_by_id(symbols: DataFrame, key: str = "id") -> DataFrame:
    """One row for each id: the last in scan order (what a map by id holds)."""
    return _one(symbols, key, F.max_by)


def _one(symbols: DataFrame, key: str, pick) -> DataFrame:
    keys = ["project", key]
    return symbols.groupBy(*keys).agg(pick(F.struct(*symbols.columns), "ord").alias("_row")).select("_row.*")


def file_links(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """project, a, b: distinct pairs of modules with a local edge from a to b.

    Links of a module to itself, and those of the unnamed root, are left out.
    """
    owner = first_by_id(symbols).select("project", F.col("id"), "module")
    local = edges.where("to_scope = 'local'").select("project", "from_id", "to_id").distinct()
    pairs = local.join(owner.select("project", F.col("id").alias("from_id"), F.col("module").alias("a")), ["project", "from_id"]).join(
        owner.select("project", F.col("id").alias("to_id"), F.col("module").alias("b")), ["project", "to_id"]
    )
    return pairs.where("a != b and a != '' and b != ''").select("project", "a", "b").distinct()


def extern_rollup(edges: DataFrame) -> DataFrame:
    """project, key, refs: references to each extern crate (or module of a built-in one)."""
    return edges.where("to_scope = 'extern'").groupBy("project", extern_key(F.col("to_path")).alias("key")).agg(F.count("*").alias("refs"))


def stats(symbols: DataFrame, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each project with the counters of a scan."""
    s = symbols.groupBy("project").agg(
        F.count("*").alias("symbols"),
        F.count_if(F.col("kind").isin("struct", "enum", "trait", "union", "type")).alias("types"),
        F.count_if(F.col("kind").isin("fn", "method")).alias("fns"),
    )
    m = modules.groupBy("project").agg(F.countDistinct("file").alias("files"), F.count("*").alias("modules"), F.sum("loc").cast("bigint").alias("loc"))
    e = edges.groupBy("project").agg(F.count("*").alias("edges"))
    return m.join(s, "project", "left").join(e, "project", "left").na.fill(0)

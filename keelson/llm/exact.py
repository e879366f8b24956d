"""Exact duplicates, with frequent digests split off before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, materialise, unused, whole

#: Counters that the frequent-item summary keeps. A digest it does not name occurs in fewer
#: than about 3.5 / TRACKED of the rows, which bounds the groups left to the ordinary shuffle.
TRACKED = 16384
#: At most so many digests are broadcast.
HEAVY = 2048
#: Summaries that are added up in the end; each merges those of its share of the partitions.
SLICES = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole(text), f"[{SPACE}]+", " ")


def _verdicts(rows: DataFrame, tracked: int, heavy: int) -> DataFrame:
    """rows (doc_id, text_sha256, row), written before, with first (a struct of none, id, row) and group_size.

    Summaries are made for slices of the partitions and their named digests added up, so no task
    merges the summaries of all partitions.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    slices = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(SLICES)).alias("slice"))
    named = slices.agg(F.expr(f"approx_top_k(text_sha256, {int(heavy)}, {int(tracked)})").alias("top")).select(F.explode("top").alias("top"))
    named = named.groupBy(F.col("top.item").alias("text_sha256")).agg(F.sum("top.count").alias("n")).where("n > 1").orderBy(F.desc("n"), "text_sha256").limit(heavy).select("text_sha256")
    winners = rows.join(F.broadcast(named), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    # at most `heavy` rows: counted exactly here, and read twice below
    winners = materialise(winners.where("group_size > 1"))
    split = rows.join(F.broadcast(winners), "text_sha256", "left_outer")
    frequent = split.where(F.col("group_size").isNotNull())
    rest = split.where(F.col("group_size").isNull()).select("doc_id", "text_sha256", "row")
    groups = rest.groupBy("text_sha256").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    return frequent.unionByName(rest.join(groups, "text_sha256"))


def _digests(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"), row.alias("row"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of white space has become one blank.
    Misra-Gries summaries (Spark's approx_top_k) name digests that may be frequent; their exact
    sizes and first rows, at most `heavy` of them, are broadcast, so that rows of huge groups are
    judged where they are. All other digests are aggregated and joined back in the ordinary way.

    Null texts count as empty. Null ids sort last; a group of null ids only has a null keep_id.
    Among repeated rows of the smallest id exactly one is kept. An empty table gives no rows;
    other columns of docs, whatever they are called, play no part.
    """
    found = _verdicts(materialise(_digests(docs, id_col, text_col, F.monotonically_increasing_id())), tracked, heavy)
    return found.select("doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """The rows of docs whose text is the first of its group, with all their columns.

    Groups are those of exact_duplicates(): null texts are equal to empty ones. Of rows that
    repeat both id and normalised text the one stays whose columns come first, in the order of
    their hash, so that reruns keep the same. An empty table gives none; columns of docs may have
    any names.
    """
    hashed = F.xxhash64(*[F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])
    rows = materialise(_digests(docs, id_col, text_col, hashed))
    name = lambda sha, doc_id, row: F.concat_ws(":", sha, row.cast("string"), doc_id.cast("string"))
    key = unused(docs, "key")
    kept = _verdicts(rows, tracked, heavy).where(F.col("row") == F.col("first.row")).select(name(F.col("text_sha256"), F.col("doc_id"), F.col("row")).alias(key)).distinct()
    keyed = docs.withColumn(key, name(F.sha2(normalised(F.col(text_col)), 256), F.col(id_col), hashed))
    # what is left twice is the same in all columns; such rows are next to each other after the join
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)

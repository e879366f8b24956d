"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialise, unit_interval, unused, whole, word_count

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
MOST = 3


def _ordinals(sources: DataFrame) -> DataFrame:
    """sources with ord, their position by code point, null last; no task sees more than its range."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = materialise(sources.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").count().withColumn("_before", F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_range").select("source", "source_size", (within + F.coalesce("_before", F.lit(0))).alias("ord"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target for the rows (source, source_size), one for each source.

    The sum of all sizes is shared by weight; a target stops at `most` times its source's size
    and the excess is shared among the others by weight until none is above. With level = what
    a weight of 1 gets, capped sources are those with most * size < level * weight; each round
    is one aggregate over the sources, and a round that caps no further source is the last.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    named = materialise(_ordinals(sizes).withColumn("weight", weight.cast("long")))
    total = named.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        n, held, free = named.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (total - held) / free
    cap = F.col("source_size") * most
    target = F.when(cap <= F.lit(level) * F.col("weight"), cap.cast("double")).otherwise(F.lit(float(level)) * F.col("weight"))
    return named.select("source", "source_size", "weight", target.alias("target"))


def _key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), whole(text))


def mixture(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, copies, taken.

    Sizes are words (null text: 0). A source's rate is target / source_size; each document is
    taken floor(rate) times and once more when a number drawn from the hash of seed and doc_id
    (of the text, where doc_id is null) is below the fraction, so reruns and other partitions
    give the same mix. Repeated rows are drawn alike. Sources without words get target 0 and no
    copies. A null source is a source of its own, the last. No rows in, no rows out.

    The sizes by source are summed before the shuffle; documents only meet the table of sources.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            unit_interval(F.concat(F.lit(seed), F.lit(":"), _key(F.col(id_col), F.col(text_col)))).alias("_draw"),
        )
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rates = targets.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumnRenamed("source", "_source")
    joined = sized.join(rates, sized["source"].eqNullSafe(rates["_source"]), "left")
    copies = (F.floor("_rate") + (F.col("_draw") < F.col("_rate") - F.floor("_rate")).cast("int")).cast("long")
    out = joined.withColumn("copies", copies)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus itself: rows of docs, each as often as it is taken (see mixture()).

    Null texts have no words, and a source without words gives no copies. Repeated rows are drawn
    alike; no rows in, no rows out; columns of docs may have any names.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(word_count(F.col(text_col))).alias("source_size"))
    rates = source_targets(sizes, weights, most)
    from_source, rate, copy = unused(docs, "from_source"), unused(docs, "rate"), unused(docs, "copy")
    rates = rates.select(F.col("source").alias(from_source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    draw = unit_interval(F.concat(F.lit(seed), F.lit(":"), _key(F.col(id_col), F.col(text_col))))
    joined = docs.join(rates, F.col(source_col).eqNullSafe(F.col(from_source)), "left")
    copies = (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("int")).cast("int")
    often = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies)))
    return often.select(*docs.columns)

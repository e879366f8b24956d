"""A training corpus from documents: quality, exact and near copies, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keelson.llm import bpe, exact, mixing, quality, simhash
from keelson.llm.queries import RANK_FILE, quality_model
from keelson.llm.shared import materialise


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, with all their columns.

    The model is fitted on the labels of sf_dir and the texts of docs. Null and empty texts have the
    score of the bias alone; repeated rows are judged alike; an empty table stays empty."""
    return quality.keep_good(docs, quality_model(spark, docs, sf_dir))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by doc_id, of each text; null texts are equal to empty ones, null ids come last,
    and of rows that repeat an id one stays, the same on reruns."""
    return exact.drop_exact_duplicates(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by doc_id, null last, of each group of near copies; texts without words, null
    ones too, are one group; of rows that repeat an id one stays."""
    return simhash.drop_near_duplicates(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; a null source is one of its own; a source without words,
    so one of null texts, gives no rows; repeated rows are taken alike."""
    return mixing.mix(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests, one row per row of docs; null texts have no tokens."""
    return bpe.with_digests(bpe.tokenise(docs, RANK_FILE, public_tokenizers.PATTERN))


STAGES = [("quality", _quality), ("exact_dedup", _exact), ("near_dedup", _near), ("mixing", _mix), ("bpe", _tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs

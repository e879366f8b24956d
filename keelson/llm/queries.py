"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact, langid, mixing, quality, secrets, simhash, substring, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The ranks that documents are encoded by.
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Fixed values of the URL contract.
URL_RULES = [
    urls.UrlRule("block", "com", "/en/"),
    urls.UrlRule("allow", "example.com", "/en/7"),
    urls.UrlRule("block", "net", "/de/"),
    urls.UrlRule("block", "example.net", "/de/8"),
    urls.UrlRule("block", "org", "/es/"),
]


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.tokenise(_table(spark, sf_dir, "documents"), RANK_FILE, public_tokenizers.PATTERN)
    return bpe.with_digests(tokens)


def _remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of, F.lit(-1))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs, _remainder(F.col("doc_id"), 4) == 2)
    return langid.predict_languages(docs, model).select("doc_id", (_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.QualityModel:
    return quality.fit_quality(docs, _table(spark, sf_dir, "labels"), _remainder(F.col("doc_id"), 5) == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.with_digests(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).drop("url")


QUERIES = {
    "op1_ann": op1_ann,
    "op2_substring": op2_substring,
    "op3_bpe": op3_bpe,
    "op4_langid": op4_langid,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
}

OP5_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER w, 0) AS held,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, weight, source NULLS LAST) AS k
  FROM src WINDOW w AS (ORDER BY 3.0 * source_size / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lvl AS (
  SELECT (total - held)::DOUBLE / free AS level FROM ranked
  WHERE (total - held)::DOUBLE / free * weight <= 3 * source_size ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN 3 * source_size <= coalesce(level, 0) * weight THEN (3 * source_size)::DOUBLE ELSE coalesce(level, 0) * weight END AS target
  FROM src LEFT JOIN lvl ON true
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         row_number() OVER () AS r
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP9_SQL = r"""
WITH rules(verdict, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), u AS (
  SELECT page_id, row_number() OVER () AS r,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), j AS (
  SELECT page_id, r, u.host, u.path, rules.host || rules.path AS rule, verdict,
         row_number() OVER (PARTITION BY r ORDER BY length(rules.host || rules.path) DESC NULLS LAST) AS n
  FROM u LEFT JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE n = 1
"""

ORACLES = {"op5_mixing": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op9_url_filter": OP9_SQL}

"""The queries of the operators: thin digests of what they return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctph, line_dedup, mixing, near_vectors, packing, quality, secret_scan, simhash, suffix_dedup, tokens
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
bad AS (SELECT k FROM n WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT coalesce('s' || source, '-')) >= 10),
m AS (SELECT n.*, bad.k IS NOT NULL AS gone FROM n LEFT JOIN bad USING (k)),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone, count(*) FILTER (NOT gone AND k <> '') AS n_left,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM m GROUP BY doc_id),
c AS (SELECT text, count(*) AS copies FROM documents GROUP BY text),
t AS (
  SELECT x.doc_id, x.text, n_lines, n_gone, coalesce(kept, '') AS kept, n_gone > 0 AND (n_left > 0 OR copies = 1) AS acts
  FROM documents x LEFT JOIN d USING (doc_id) LEFT JOIN c ON x.text = c.text)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, (CASE WHEN acts THEN n_gone ELSE 0 END)::BIGINT AS n_removed,
  length(CASE WHEN acts THEN kept ELSE text END)::BIGINT AS kept_chars, sha256(CASE WHEN acts THEN kept ELSE text END) AS kept_sha256
FROM t
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), budgets=(512,))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "chars_within_512")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edited(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_near_vectors, op3_suffix_dedup, op4_simhash, op5_line_dedup, op6_packing, op7_secrets, op8_mixing, op9_tokens, op10_fingerprints)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL}

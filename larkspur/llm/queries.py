"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import exact_dedup, line_crf, mixing, near_dup, packing, pii, quality_rules, sharding, substring_dedup, wavelet
from larkspur.llm.common import fresh_path, read_table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"), keep="max")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back from the compacted shards, so loss, repetition or change would show."""
    table = sharding.shard_table(read_table(spark, sf_dir, "documents"))
    return table.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents")).drop("text_key")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_crf.score(docs, line_crf.fit(docs, read_table(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "wavelet")
    wavelet.write_shards(read_table(spark, sf_dir, "documents"), path, tokenizer="byte_bpe_50k.json")
    return wavelet.documents_of(spark, path)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sample_to_targets(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), q AS (
  SELECT doc_id, source, size,
    CASE WHEN size > 0 THEN greatest(0.05, 1.0::DOUBLE - least(1.0::DOUBLE, len(regexp_extract_all(text, '[#*$%&|<>]'))::DOUBLE / size)) ELSE 0.05 END AS weight,
    (('0x' || substr(md5('11:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d
), k AS (SELECT doc_id, source, size, -ln(u) / weight AS key FROM q
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), o AS (
  SELECT *, (SELECT arg_min(level, cap / w) FROM l WHERE level * w < cap) AS open_level FROM l
), t AS (
  SELECT source, source_size, least(cap, coalesce(open_level * w, cap))::DOUBLE AS target FROM o
), b AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
), c AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, round(b.target - b.epochs * b.source_size)::BIGINT AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sharding": op2_sharding,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_packing": op5_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pii": op7_pii,
    "op8_token_output": op8_token_output,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_sharding": OP2_SQL, "op10_mixing": OP10_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

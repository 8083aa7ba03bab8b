"""From raw documents to packed sequences: quality, exact copies, near copies, source mixture, packing.

Each stage gets the documents that the stage before it kept, as a table in the shared folder, and returns
documents with the same columns; the last returns the packed pieces. A lost executor repeats tasks of
its stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import exact_dedup, line_crf, mixing, near_dup, packing
from larkspur.llm.common import read_table, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject. It is fitted to the labelled rows among ``docs``."""
    return line_crf.drop_low_quality(docs, line_crf.fit(docs, read_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest identifier."""
    return exact_dedup.drop_exact_copies(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest identifier."""
    return near_dup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, left out, or cut where a source's words are reached."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packed)]

#: The trained classifier and the tokenizer can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact deduplication by content sort, with DataFrame functions only.

Sampled splitters deal the normalised texts out to sorted ranges (``repartitionByRange``), the
external sort of each range places equal texts next to each other, and a window over the sorted run
compares neighbouring texts in full and keeps one identifier. A range key is a short prefix of the
text and a hash of all of it, so splitters stay small however long the texts are and texts with a
common beginning still spread; equal texts always have equal keys.

Hot groups: each row is dealt with a salt of its place in the input, so that a group of any size, with identifiers or
without, becomes up to ``salts`` runs in different ranges. Each run is first settled on its own; then one short line per run
(digest, best identifier, count) is settled per text. Neither step holds a whole group in a task.

Defined results: a null text equals the empty one; of equal texts the largest identifier stays
(``keep="max"``) or the smallest (``keep="min"``); a null identifier loses against any other and
stays only when its whole group has none; of rows that share text and identifier exactly one is
marked kept, and which of them isn't defined where further columns differ; an empty table gives an empty table; further columns, whatever their names, don't
matter. Texts differing in anything but the case of A-Z differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import ascii_lower, partitions, stage

SALTS = 256


def _best(keep: str) -> Column:
    key = F.col("_id")
    return {"max": key.desc_nulls_last(), "min": key.asc_nulls_last()}[keep]


def sorted_runs(docs: DataFrame, id_col: str, text_col: str, keep: str, salts: int, carry: bool) -> DataFrame:
    """A line per row: identifier, salt, digest, place in its run, and its run's best identifier and size.

    With ``carry`` the row itself is kept in the struct ``_row``.
    """
    n = partitions(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        ascii_lower(text).alias("_norm"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []),
    )
    keyed = base.select(
        "*",
        F.substring("_norm", 1, 24).alias("_prefix"),
        F.xxhash64("_norm").alias("_hash"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("_salt"),
    )
    dealt = keyed.repartitionByRange(n, "_prefix", "_hash", "_salt")
    run = Window.partitionBy("_prefix", "_hash", "_norm", "_salt")
    order = run.orderBy(_best(keep))
    return dealt.select(
        "_id",
        "_salt",
        F.unhex(F.sha2("_norm", 256)).alias("_digest"),
        F.row_number().over(order).alias("_place"),
        F.first("_id").over(order).alias("_run_id"),
        F.count(F.lit(1)).over(run).alias("_run_n"),
        *(["_row"] if carry else []),
    )


def _settle(runs: DataFrame, keep: str) -> DataFrame:
    """Per run: the identifier that stays for its whole text, the text's count, and whether this run holds it."""
    text = Window.partitionBy("_digest")
    order = text.orderBy(F.col("_run_id").desc_nulls_last() if keep == "max" else F.col("_run_id").asc_nulls_last(), F.col("_salt"))
    heads = runs.filter(F.col("_place") == 1).select("_digest", "_salt", "_run_id", "_run_n")
    return heads.select(
        "_digest",
        "_salt",
        F.first("_run_id").over(order).alias("_keep_id"),
        F.sum("_run_n").over(text).alias("_group"),
        (F.row_number().over(order) == 1).alias("_holds"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", salts: int = SALTS) -> DataFrame:
    """One line per row: identifier, keep_id, group_size, kept and the digest of the normalised text."""
    runs = stage(sorted_runs(docs, id_col, text_col, keep, salts, carry=False), "exact-runs")
    return runs.join(_settle(runs, keep), ["_digest", "_salt"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep_id").alias("keep_id"),
        F.col("_group").cast("long").alias("group_size"),
        (F.col("_holds") & (F.col("_place") == 1)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    runs = stage(sorted_runs(docs, id_col, text_col, keep, salts, carry=True).filter("_place = 1"), "exact-heads")
    chosen = _settle(runs, keep).filter("_holds").select("_digest", "_salt")
    return runs.join(chosen, ["_digest", "_salt"]).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])

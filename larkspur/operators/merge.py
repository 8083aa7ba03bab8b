"""Merging candidate lists: unions with provenance, per-source caps, budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.folds import top_rank

BASE_CAP = 500
POPULARITY_CAP = 100
TOLERANCE = 0.0002


def merge_records(records: DataFrame) -> DataFrame:
    """A line per pair: its best rank, its sources (sorted), their number, and its place for the customer."""
    pairs = records.groupBy("customer_id", "article_id").agg(
        F.min("source_rank").alias("best_rank"), F.array_sort(F.collect_set("source_name")).alias("source_names"), F.count_distinct("source_name").alias("num_sources")
    )
    return top_rank(pairs, ["customer_id"], ["best_rank", "article_id"], None, "position")


def article_lists(merged: DataFrame) -> DataFrame:
    """Articles in order, as an array per customer."""
    return merged.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("position", "article_id"))).alias("_l")).select("customer_id", F.col("_l.article_id").alias("article_ids"))


def source_order(sources: Sequence[str]) -> Column:
    return F.element_at(F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))]), F.col("source_name"))


def ordered_union(records: DataFrame, sources: Sequence[str], cap: int = BASE_CAP, caps: Mapping[str, int] | None = None) -> DataFrame:
    """First-come union: sources in order, each up to its cap; a pair stands where it comes first."""
    limit = F.lit(cap)
    for s, c in (caps or {}).items():
        limit = F.when(F.col("source_name") == s, c).otherwise(limit)
    kept = records.filter(F.col("source_name").isin(*sources) & (F.col("source_rank") <= limit))
    first = kept.groupBy("customer_id", "article_id").agg(F.min(F.struct(source_order(sources).alias("o"), F.col("source_rank").alias("r"))).alias("f"))
    return top_rank(first.select("customer_id", "article_id", F.col("f.o").alias("first_source"), F.col("f.r").alias("first_rank")), ["customer_id"], ["first_source", "first_rank", "article_id"], None, "position")


def apply_budget(features: DataFrame, sources: Sequence[str], variable: str, budget: int | Mapping[str, int], fixed: Mapping[str, int] | None = None, bucket_col: str = "bucket") -> DataFrame:
    """Drop what each source ranks beyond its budget; a pair that no source has left goes.

    ``budget`` of the variable source is a number or one for each history bucket. Ranks stay as they were.
    """
    fixed = dict(fixed or {})
    out = features
    allowed = []
    for s in sources:
        if s == variable:
            if isinstance(budget, Mapping):
                cap = F.lit(0)
                for name, n in budget.items():
                    cap = F.when(F.col(bucket_col) == name, n).otherwise(cap)
            else:
                cap = F.lit(budget)
        else:
            cap = F.lit(fixed.get(s, POPULARITY_CAP if "pop" in s else BASE_CAP))
        ok = (F.col(f"is_{s}") == 1) & (F.col(f"rank_{s}") <= cap)
        out = out.withColumn(f"_ok_{s}", F.coalesce(ok, F.lit(False)))
        allowed.append(s)
    for s in allowed:
        ok = F.col(f"_ok_{s}")
        out = out.withColumns({f"is_{s}": ok.cast("int"), **{c: F.when(ok, F.col(c)) for c in (f"rank_{s}", f"rank_pct_{s}", f"score_{s}")}})
    total = sum((F.col(f"is_{s}") for s in allowed[1:]), F.col(f"is_{allowed[0]}"))
    return out.withColumn("num_sources", total).filter("num_sources > 0").drop(*[f"_ok_{s}" for s in allowed])


def choose_budget(results: DataFrame, by: Sequence[str] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """Of (budget, fold, map): the smallest budget whose mean is within the tolerance of the best."""
    means = results.groupBy(*by, "budget").agg(F.avg("map").alias("mean_map"))
    best = means.withColumn("_best", F.max("mean_map").over(Window.partitionBy(*by)))
    return best.groupBy(*by).agg(F.min(F.when(F.round(F.col("mean_map") - F.col("_best") + tolerance, 9) >= 0, F.col("budget"))).alias("chosen_budget"), F.max("_best").alias("best_map"))


def budget_efficiency(results: DataFrame) -> DataFrame:
    """Of (fold, budget, hits, candidates): hits gained per 10,000 candidates added, against budget 0."""
    zero = results.filter("budget = 0").select("fold", F.col("hits").alias("_h"), F.col("candidates").alias("_c"))
    joined = results.join(zero, "fold").withColumns({"added_hits": F.col("hits") - F.col("_h"), "added_candidates": F.col("candidates") - F.col("_c")})
    return joined.select("fold", "budget", "added_hits", "added_candidates", (F.col("added_hits") * 10000.0 / F.nullif(F.col("added_candidates"), F.lit(0))).alias("hits_per_10k"))


def accepts(results: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Of (fold, base, arm): better on average by more than the tolerance, and worse by more in no fold."""
    return results.agg(((F.avg("arm") > F.avg("base") + tolerance) & F.bool_and(F.col("arm") >= F.col("base") - tolerance)).alias("accepted"))

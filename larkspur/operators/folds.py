"""Temporal protocol: folds, labels, samples and holdouts. Folds are rows, so many cutoffs cost one scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import history_bucket


def weekly_windows(spark: SparkSession, last_day: str, weeks: int) -> DataFrame:
    """(fold, train_end, recent_start, target_start, target_end), oldest first, the last ending on ``last_day``."""
    if weeks <= 0:
        raise ValueError("weeks must be positive")
    end = F.lit(last_day).cast("date")
    fold = spark.range(weeks).select(F.col("id").alias("_i"))
    ends = fold.select((F.col("_i") + 1).alias("fold"), F.date_sub(end, ((weeks - 1 - F.col("_i")) * 7).cast("int")).alias("target_end"))
    return ends.select(
        "fold", F.date_sub("target_end", 7).alias("train_end"), F.date_sub("target_end", 13).alias("recent_start"), F.date_sub("target_end", 6).alias("target_start"), "target_end"
    )


def month_folds(spark: SparkSession, cutoffs: Sequence[str], days: int = 28) -> DataFrame:
    """(fold, cutoff, target_start, target_end) for given cutoffs."""
    rows = [(i + 1, c := date.fromisoformat(d), c + timedelta(days=1), c + timedelta(days=days)) for i, d in enumerate(cutoffs)]
    return spark.createDataFrame(rows, "fold long, cutoff date, target_start date, target_end date")


def labels(tx: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct (customer_id, article_id) bought in a window."""
    return tx.filter(F.col("transaction_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("customer_id", "article_id").distinct()


def before(tx: DataFrame, cutoff: str) -> DataFrame:
    return tx.filter(F.col("transaction_date") <= F.lit(cutoff).cast("date"))


def warm_cold(label_rows: DataFrame, history: DataFrame) -> DataFrame:
    """Customers with labels: how many, and whether they have no history."""
    n = label_rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_labels"))
    seen = history.select(F.col("customer_id").alias("_c")).distinct()
    return n.join(seen, n.customer_id == F.col("_c"), "left").select("customer_id", "n_labels", F.col("_c").isNull().alias("is_cold_customer"))


def history_buckets(customers: DataFrame, history: DataFrame) -> DataFrame:
    """Each customer's purchases so far and the bucket of their number; none counts too."""
    n = history.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    return customers.select("customer_id").distinct().join(n, "customer_id", "left").select(
        "customer_id", F.coalesce("_n", F.lit(0)).alias("n_history"), history_bucket(F.coalesce("_n", F.lit(0))).alias("bucket")
    )


def fold_populations(tx: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows, customers and articles of each fold's target window, in one scan."""
    inside = tx.join(F.broadcast(folds), tx.transaction_date.between(folds.target_start, folds.target_end))
    return inside.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("customer_id").alias("n_customers"), F.count_distinct("article_id").alias("n_articles")
    )


def first_customers(label_rows: DataFrame, n: int) -> DataFrame:
    """The first n customers by identifier: a reproducible sample."""
    return label_rows.select("customer_id").distinct().orderBy("customer_id").limit(n)


def seeded(seed: int, *keys: str) -> Column:
    """An arbitrary order of keys that a seed settles, the same in every engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hashed_sample(customers: DataFrame, n: int, seed: int) -> DataFrame:
    """n customers in the order of a seeded hash; the same on every run and cluster."""
    return customers.select("customer_id").distinct().orderBy(seeded(seed, "customer_id"), "customer_id").limit(n)


def holdout_pool(everyone: DataFrame, *used: DataFrame) -> DataFrame:
    """Customers that no development step has seen."""
    out = everyone.select("customer_id").distinct()
    for u in used:
        out = out.join(u.select("customer_id").distinct(), "customer_id", "left_anti")
    return out


def eligible_articles(catalogue: DataFrame, policy: str, history: DataFrame | None = None) -> DataFrame:
    """All of the catalogue, or only what has been bought before the cutoff."""
    ids = catalogue.select("article_id").distinct()
    if policy == "full_catalog":
        return ids
    if policy == "observed_before_cutoff":
        if history is None:
            raise ValueError("observed_before_cutoff needs the history")
        return ids.join(history.select("article_id").distinct(), "article_id", "left_semi")
    raise ValueError(f"unknown policy {policy}")


def top_rank(df: DataFrame, by: Sequence[str], order: Sequence, k: int | None, name: str = "rank") -> DataFrame:
    """Rank rows within groups, keeping the first k."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return ranked if k is None else ranked.filter(F.col(name) <= k)

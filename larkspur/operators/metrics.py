"""Ranking and retrieval metrics as relations: predictions and labels in, a line of figures out.

Labels decide who counts: customers without predictions score 0. An empty label set gives 0 customers and null figures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 12


def first_places(predictions: DataFrame, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """A repeated article keeps its first place; the places it repeats stay used."""
    return predictions.groupBy(*keys, "article_id").agg(F.min("rank").alias("rank"))


def average_precision(label_rows: DataFrame, predictions: DataFrame, k: int = K, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """(keys, n_relevant, hits, ap, recall) of every customer with labels."""
    relevant = label_rows.select(*keys, "article_id").distinct()
    hits = first_places(predictions, keys).filter(F.col("rank") <= k).join(relevant, [*keys, "article_id"], "left_semi")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    summed = hits.withColumn("_p", nth / F.col("rank")).groupBy(*keys).agg(F.sum("_p").alias("_sum"), F.count(F.lit(1)).alias("_hits"))
    n = relevant.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_relevant"))
    out = n.join(summed, list(keys), "left")
    hit = F.coalesce("_hits", F.lit(0))
    return out.select(*keys, "n_relevant", hit.alias("hits"), (F.coalesce("_sum", F.lit(0.0)) / F.least(F.col("n_relevant"), F.lit(k))).alias("ap"), (hit / F.col("n_relevant")).alias("recall"))


def summarise(per_customer: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_customer.groupBy(*by).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("ap").alias("map_at_k"), F.avg("recall").alias("macro_recall_at_k"), (F.sum("hits") / F.sum("n_relevant")).alias("micro_recall_at_k"),
        F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate_at_k"),
    )


def ranking_metrics(label_rows: DataFrame, predictions: DataFrame, catalogue_size: int | DataFrame, k: int = K) -> DataFrame:
    """One line: MAP, macro and micro recall, hit rate, and the share of the catalogue that is shown."""
    who = label_rows.select("customer_id").distinct()
    shown = predictions.filter(F.col("rank") <= k).join(who, "customer_id", "left_semi").agg(F.count_distinct("article_id").alias("_shown"))
    out = summarise(average_precision(label_rows, predictions, k)).crossJoin(F.broadcast(shown))
    if isinstance(catalogue_size, int):
        if catalogue_size <= 0:
            raise ValueError("the catalogue must have articles")
        size: Column = F.lit(catalogue_size)
    else:
        out = out.crossJoin(F.broadcast(catalogue_size.agg(F.count_distinct("article_id").alias("_size"))))
        size = F.col("_size")
    return out.withColumn("coverage_at_k", F.col("_shown") / size).drop("_shown", "_size")


def retrieval_metrics(label_rows: DataFrame, candidates: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, k, customers, recall, hit rate, matched pairs) for several cuts in one pass. candidates has ``rank``."""
    relevant = label_rows.select("customer_id", "article_id").distinct()
    sizes = relevant.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    cuts = candidates.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    first = first_places(candidates, [*by, "customer_id"])
    hits = first.join(relevant, ["customer_id", "article_id"], "left_semi").join(F.broadcast(cuts), F.col("rank") <= F.col("k"))
    per = hits.groupBy(*by, "k", "customer_id").agg(F.count(F.lit(1)).alias("hits"))
    grid = F.broadcast(cuts)
    if by:
        grid = F.broadcast(candidates.select(*by).distinct().crossJoin(grid))
    full = sizes.crossJoin(grid).join(per, [*by, "k", "customer_id"], "left").na.fill(0, ["hits"])
    return full.groupBy(*by, "k").agg(
        F.count(F.lit(1)).alias("customers"), F.avg(F.col("hits") / F.col("n_relevant")).alias("macro_recall"), (F.sum("hits") / F.sum("n_relevant")).alias("micro_recall"),
        F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"), F.sum("hits").alias("matched_pairs"),
    )


def coverage(candidates: DataFrame, catalogue: DataFrame, largest: int) -> DataFrame:
    shown = candidates.filter(F.col("rank") <= largest).agg(F.count_distinct("article_id").alias("_n"))
    return shown.crossJoin(F.broadcast(catalogue.agg(F.count_distinct("article_id").alias("_size")))).select((F.col("_n") / F.col("_size")).alias("coverage"))


def oracle_map(label_rows: DataFrame, pool: DataFrame, k: int = K) -> DataFrame:
    """What the best order of a pool could score."""
    relevant = label_rows.select("customer_id", "article_id").distinct()
    hits = relevant.join(pool.select("customer_id", "article_id").distinct(), ["customer_id", "article_id"], "left_semi").groupBy("customer_id").agg(F.count(F.lit(1)).alias("_h"))
    n = relevant.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).join(hits, "customer_id", "left")
    return n.agg(F.avg(F.least(F.coalesce("_h", F.lit(0)), F.lit(k)) / F.least("n", F.lit(k))).alias("oracle_map"), F.count(F.lit(1)).alias("customers"))


def pool_metrics(label_rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Recall, hit rate and mean pool size of customers with labels."""
    relevant = label_rows.select("customer_id", "article_id").distinct()
    unique = pool.select("customer_id", "article_id").distinct()
    size = unique.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_pool"))
    hits = relevant.join(unique, ["customer_id", "article_id"], "left_semi").groupBy("customer_id").agg(F.count(F.lit(1)).alias("_h"))
    n = relevant.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).join(hits, "customer_id", "left").join(size, "customer_id", "left").na.fill(0)
    return n.agg(
        F.count(F.lit(1)).alias("customers"), (F.sum("_h") / F.sum("n")).alias("micro_recall"), F.avg(F.col("_h") / F.col("n")).alias("macro_recall"), F.avg((F.col("_h") > 0).cast("double")).alias("hit_rate"),
        F.avg("_pool").alias("mean_pool"),
    )


def ndcg(judged: DataFrame, query: str = "query_id", k: int = 10, gain: str = "linear", ideal: str = "returned") -> DataFrame:
    """(query, ndcg). judged: query, rank (null if not returned), relevance.

    gain: linear, or exponential 2**g - 1. ideal: the best order of what was returned, of all judged, or of binary labels.
    """
    g = F.col("relevance").cast("double") if gain == "linear" else F.pow(F.lit(2.0), F.col("relevance")) - 1
    if ideal == "binary":
        g = (F.col("relevance") > 0).cast("double")
    rows = judged.withColumn("_g", g)
    pool = rows.filter("rank IS NOT NULL") if ideal == "returned" else rows
    best = pool.withColumn("_i", F.row_number().over(Window.partitionBy(query).orderBy(F.col("_g").desc())))
    top = best.filter(F.col("_i") <= k).groupBy(query).agg(F.sum(F.col("_g") / F.log2(F.col("_i") + 1.0)).alias("_ideal"))
    got = rows.filter(F.col("rank") <= k).groupBy(query).agg(F.sum(F.col("_g") / F.log2(F.col("rank") + 1.0)).alias("_dcg"))
    return judged.select(query).distinct().join(top, query, "left").join(got, query, "left").select(query, F.coalesce(F.try_divide("_dcg", F.nullif(F.col("_ideal"), F.lit(0.0))), F.lit(0.0)).alias("ndcg"))


def search_metrics(judged: DataFrame, query: str = "query_id", p: int = 10, r: int = 50) -> DataFrame:
    """(query, precision, recall, mrr): recall against the smaller of the relevant and r."""
    rel = F.col("relevance") > 0
    return judged.groupBy(query).agg(
        (F.count_if(rel & (F.col("rank") <= p)) / F.lit(p)).alias("precision"),
        F.coalesce(F.try_divide(F.count_if(rel & (F.col("rank") <= r)).cast("double"), F.least(F.count_if(rel), F.lit(r)).cast("double")), F.lit(0.0)).alias("recall"),
        F.coalesce(1.0 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("mrr"),
    )

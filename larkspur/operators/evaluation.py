"""Reports over candidate sources and rankings: overlap, marginal gains, segments, failures, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import tertile
from larkspur.operators.merge import source_order

PAIR = ["customer_id", "article_id"]


def eligibility_ceiling(label_rows: DataFrame, eligible: DataFrame) -> DataFrame:
    """What part of the label pairs, and of the customers, an eligibility rule leaves within reach."""
    left = label_rows.join(eligible.select("article_id").distinct(), "article_id", "left_semi")
    a = label_rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("customer_id").alias("customers"))
    b = left.agg(F.count(F.lit(1)).alias("reachable_pairs"), F.count_distinct("customer_id").alias("reachable_customers"))
    return a.crossJoin(b).withColumns({"pair_ceiling": F.col("reachable_pairs") / F.col("pairs"), "customer_ceiling": F.col("reachable_customers") / F.col("customers")})


def source_hits(label_rows: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """Label pairs that each source reaches within its first k."""
    top = records.filter(F.col("source_rank") <= k).select(*PAIR, "source_name").distinct()
    return top.join(label_rows.select(*PAIR).distinct(), PAIR, "left_semi")


def marginal_recall(label_rows: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(source_name, hits, unique_hits, shared_hits, unique_share)."""
    hits = source_hits(label_rows, records, k)
    n = hits.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*PAIR)))
    out = n.groupBy("source_name").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("_n") == 1).alias("unique_hits"))
    return out.withColumns({"shared_hits": F.col("hits") - F.col("unique_hits"), "unique_share": F.col("unique_hits") / F.col("hits")})


def pairwise_overlap(records: DataFrame, k: int) -> DataFrame:
    """(source_a, source_b, shared, jaccard) over all customers' pairs, each source with itself too."""
    top = records.filter(F.col("source_rank") <= k).select(*PAIR, "source_name").distinct()
    sizes = top.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
    a = top.withColumnRenamed("source_name", "source_a")
    shared = a.join(top.withColumnRenamed("source_name", "source_b"), PAIR).groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("shared"))
    grid = sizes.select(F.col("source_name").alias("source_a"), F.col("n").alias("na")).crossJoin(F.broadcast(sizes.select(F.col("source_name").alias("source_b"), F.col("n").alias("nb"))))
    out = grid.join(shared, ["source_a", "source_b"], "left").na.fill(0, ["shared"])
    return out.select("source_a", "source_b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def incremental_union(label_rows: DataFrame, records: DataFrame, sources: Sequence[str], k: int) -> DataFrame:
    """Sources added one after the other: pairs, hits and recall of the union so far."""
    top = records.filter((F.col("source_rank") <= k) & F.col("source_name").isin(*sources))
    first = top.groupBy(*PAIR).agg(F.min(source_order(sources)).alias("step"))
    marked = first.join(label_rows.select(*PAIR).distinct().withColumn("_hit", F.lit(1)), PAIR, "left")
    per = marked.groupBy("step").agg(F.count(F.lit(1)).alias("new_pairs"), F.count("_hit").alias("new_hits"))
    total = F.broadcast(label_rows.select(*PAIR).distinct().agg(F.count(F.lit(1)).alias("_all")))
    w = Window.orderBy("step")  # a line per source
    name = F.element_at(F.array(*[F.lit(s) for s in sources]), F.col("step") + 1)
    run = per.crossJoin(total).withColumns({"pool_pairs": F.sum("new_pairs").over(w), "hits": F.sum("new_hits").over(w)})
    return run.select(F.col("step").cast("long").alias("step"), name.alias("source_name"), "new_pairs", "new_hits", "pool_pairs", "hits", (F.col("hits") / F.col("_all")).alias("recall"))


def recall_by(label_rows: DataFrame, pool: DataFrame, segments: DataFrame, key: str, segment: str = "segment") -> DataFrame:
    """Pairs, hits and recall in each segment of customers or articles."""
    marked = label_rows.select(*PAIR).distinct().join(pool.select(*PAIR).distinct().withColumn("_hit", F.lit(1)), PAIR, "left")
    return marked.join(segments.select(key, segment), key).groupBy(segment).agg(F.count(F.lit(1)).alias("pairs"), F.count("_hit").alias("hits"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def item_segments(tx: DataFrame, articles: DataFrame, cutoff: str, popular_at: float = 0.8, new_days: int = 90) -> DataFrame:
    """Articles as popular or long_tail (by a quantile of purchases) and newer or established (by first purchase)."""
    end = F.lit(cutoff).cast("date")
    stats = tx.filter(F.col("transaction_date") <= end).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), F.min("transaction_date").alias("first_day"))
    all_ = articles.select("article_id").join(stats, "article_id", "left").na.fill(0, ["n"])
    cut = F.broadcast(all_.agg(F.expr(f"percentile(n, {popular_at})").alias("_q")))
    new = F.col("first_day") > F.date_sub(end, new_days)
    return all_.crossJoin(cut).select("article_id", "n", F.when(F.col("n") >= F.col("_q"), "popular").otherwise("long_tail").alias("popularity"), F.when(new, "newer").when(F.col("first_day").isNotNull(), "established").otherwise("unseen").alias("age"))


def ranked_positives(scored: DataFrame, score: str) -> DataFrame:
    """Every label pair in the pool with its place in its customer's list."""
    place = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.round(score, 9).desc(), "article_id")).cast("long")
    size = F.count(F.lit(1)).over(Window.partitionBy("customer_id"))
    return scored.withColumn("rank", place).withColumn("pool", size).filter("label = 1")


def rank_summary(positives: DataFrame, by: Sequence[str] = (), k: int = 12) -> DataFrame:
    """n, the upper median, the 90th percentile, and the share within k."""
    # Lines are counted per rank first, so a group has a line for each place of a list, however many positives it has.
    w = Window.partitionBy(*by)
    counted = positives.groupBy(*by, "rank").agg(F.count(F.lit(1)).alias("_c"))
    placed = counted.withColumn("_upto", F.sum("_c").over(w.orderBy("rank"))).withColumn("_n", F.sum("_c").over(w))
    middle = F.min(F.when(F.col("_upto") >= F.floor(F.col("_n") / 2) + 1, F.col("rank")))
    return placed.groupBy(*by).agg(
        F.sum("_c").alias("n"), middle.alias("median_rank"), F.expr("percentile(rank, 0.9, _c)").alias("p90_rank"),
        (F.sum(F.when(F.col("rank") <= k, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("top_share"),
    )


def with_tertiles(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Buckets by the tertiles of a column over all rows."""
    cuts = F.broadcast(rows.agg(F.expr(f"percentile({column}, 1/3D)").alias("_lo"), F.expr(f"percentile({column}, 2/3D)").alias("_hi")))
    return rows.crossJoin(cuts).withColumn(out, tertile(F.col(column), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def separability(scored: DataFrame, score: str, features: Sequence[str], tail: Column, k: int = 12) -> DataFrame:
    """Mean of each feature over tail positives ranked below k and over tail negatives ranked within it."""
    place = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.round(score, 9).desc(), "article_id"))
    rows = scored.withColumn("_place", place).filter(tail)
    kind = F.when((F.col("label") == 1) & (F.col("_place") > k), "buried").when((F.col("label") == 0) & (F.col("_place") <= k), "shown")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("v")) for f in features]))
    long = rows.withColumn("_kind", kind).filter("_kind IS NOT NULL").select("_kind", cells.alias("c")).select("_kind", "c.*")
    return long.groupBy("feature").agg(F.avg(F.when(F.col("_kind") == "buried", F.col("v"))).alias("buried_mean"), F.avg(F.when(F.col("_kind") == "shown", F.col("v"))).alias("shown_mean"), F.count_if(F.col("_kind") == "buried").alias("n_buried"), F.count_if(F.col("_kind") == "shown").alias("n_shown"))


def score_diagnostics(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How two scores differ: means by label, absolute difference, correlation."""
    d = F.abs(F.col(a) - F.col(b))
    return rows.agg(
        F.avg(F.when(F.col("label") == 1, F.col(a))).alias("positive_mean"), F.avg(F.when(F.col("label") == 0, F.col(a))).alias("negative_mean"), F.avg(d).alias("mean_abs_diff"), F.max(d).alias("max_abs_diff"), F.corr(a, b).alias("correlation"),
    )


def compare_folds(results: DataFrame) -> DataFrame:
    """Of (fold, base, arm): means, medians, and how many folds each wins (differences under 1e-12 tie)."""
    d = F.col("arm") - F.col("base")
    return results.agg(
        F.count(F.lit(1)).alias("folds"), F.avg("base").alias("base_mean"), F.avg("arm").alias("arm_mean"), F.median("base").alias("base_median"), F.median("arm").alias("arm_median"), F.avg(d).alias("mean_delta"),
        F.count_if(d > 1e-12).alias("wins"), F.count_if(F.abs(d) <= 1e-12).alias("ties"), F.count_if(d < -1e-12).alias("losses"),
    )


def describe(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    q = F.expr(f"percentile({column}, array(0.1D, 0.25D, 0.75D, 0.9D))")
    s = rows.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.median(column).alias("median"), q.alias("_q"))
    return s.select(*by, "n", "mean", "median", *[F.col("_q")[i].alias(f"p{p}") for i, p in enumerate((10, 25, 75, 90))])

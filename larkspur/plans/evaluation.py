"""Registered features, metrics and reports, with SQL for each."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import novelty, source_count
from larkspur.operators import candidates as c
from larkspur.operators import evaluation as e
from larkspur.operators import features as f
from larkspur.operators import folds, merge, metrics
from larkspur.plans.candidates import SOURCES, _embeddings, labels, r6, records
from larkspur.plans.sql import CUTOFF, END, START, compose, part
from larkspur.sources.relations import CATEGORIES, articles, customers, table, transactions
from larkspur.sources.session import shared_folder

KS = (50, 100, 300)


def base_features(s: SparkSession, d: str) -> DataFrame:
    return f.pair_features(records(s, d), transactions(s, d), articles(s, d), CUTOFF, SOURCES)


def linear_score() -> Column:
    """A fixed linear score, so that rankings can be checked without a trained model."""
    z = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    return z("score_repeat_purchase") + z("score_cooccurrence") * 0.02 + z("item_purchases_30d") * 0.01 + z("affinity_product_type_name") * 0.5 - z("rank_recent_pop") * 0.001


def scored(s: SparkSession, d: str) -> DataFrame:
    """All pool pairs with features, label and linear score."""
    return f.labelled(base_features(s, d), labels(s, d)).withColumn("lin", F.round(linear_score(), 9))


def slates(s: SparkSession, d: str) -> DataFrame:
    return folds.top_rank(scored(s, d), ["customer_id"], [F.col("lin").desc(), "article_id"], 12)


def popularity_baseline(tx: DataFrame, catalogue: DataFrame, cutoff: str, start: str, end: str, days: int | None = None, k: int = 12) -> DataFrame:
    """Metrics of one global list for everyone, over all, warm and cold customers. days: all history, or the last ``days``."""
    top = c.popular_recent(tx, cutoff, days, k) if days else c.popular_all_history(tx, cutoff, k)
    lab = folds.labels(tx, start, end)
    kind = folds.warm_cold(lab, folds.before(tx, cutoff)).select("customer_id", F.when(F.col("is_cold_customer"), "cold").otherwise("warm").alias("segment"))
    # One list serves all, so predictions are joined to labels by article and never written out per customer.
    hits = lab.join(F.broadcast(top.select("article_id", "rank")), "article_id")
    nth = F.row_number().over(Window.partitionBy("customer_id").orderBy("rank"))
    per = hits.withColumn("_p", nth / F.col("rank")).groupBy("customer_id").agg(F.sum("_p").alias("_sum"), F.count(F.lit(1)).alias("_hits"))
    n = lab.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_relevant")).join(per, "customer_id", "left").join(kind, "customer_id")
    hit = F.coalesce("_hits", F.lit(0))
    n = n.select("customer_id", "segment", "n_relevant", hit.alias("hits"), (F.coalesce("_sum", F.lit(0.0)) / F.least(F.col("n_relevant"), F.lit(k))).alias("ap"), (hit / F.col("n_relevant")).alias("recall"))
    both = n.withColumn("segment", F.explode(F.array(F.lit("overall"), "segment")))
    size = F.broadcast(catalogue.agg(F.count_distinct("article_id").alias("_all"))).crossJoin(F.broadcast(top.agg(F.count(F.lit(1)).alias("_shown"))))
    return metrics.summarise(both, ["segment"]).crossJoin(size).withColumn("coverage_at_k", F.col("_shown") / F.col("_all")).drop("_shown", "_all")


def popularity_backtest(tx: DataFrame, windows: DataFrame, k: int = 12) -> DataFrame:
    """(fold, model, customers, map, hit rate) of all history against the last week, all folds in one job."""
    daily = tx.groupBy("transaction_date", "article_id").agg(F.count(F.lit(1)).alias("n"))
    w = F.broadcast(windows)
    inside = daily.join(w, daily.transaction_date <= w.train_end)
    models = F.explode(F.array(F.struct(F.lit("all_history").alias("model"), F.lit(True).alias("in")), F.struct(F.lit("recent_7d").alias("model"), (F.col("transaction_date") >= F.col("recent_start")).alias("in")))).alias("m")
    counts = inside.select("fold", "article_id", "n", models).filter("m.in").groupBy("fold", F.col("m.model").alias("model"), "article_id").agg(F.sum("n").alias("n"))
    top = folds.top_rank(counts, ["fold", "model"], [F.col("n").desc(), "article_id"], k)
    lab = tx.join(w, tx.transaction_date.between(w.target_start, w.target_end)).select("fold", "customer_id", "article_id").distinct()
    hits = lab.join(F.broadcast(top.select("fold", "model", "article_id", "rank")), ["fold", "article_id"])
    nth = F.row_number().over(Window.partitionBy("fold", "model", "customer_id").orderBy("rank"))
    per = hits.withColumn("_p", nth / F.col("rank")).groupBy("fold", "model", "customer_id").agg(F.sum("_p").alias("_sum"))
    n = lab.groupBy("fold", "customer_id").agg(F.count(F.lit(1)).alias("n_relevant")).withColumn("model", F.explode(F.array(F.lit("all_history"), F.lit("recent_7d"))))
    j = n.join(per, ["fold", "model", "customer_id"], "left")
    return j.groupBy("fold", "model").agg(F.count(F.lit(1)).alias("customers"), F.avg(F.coalesce("_sum", F.lit(0.0)) / F.least("n_relevant", F.lit(k))).alias("map_at_k"), F.avg(F.col("_sum").isNotNull().cast("double")).alias("hit_rate_at_k"))


def _compare(s: SparkSession, d: str) -> DataFrame:
    b = popularity_backtest(transactions(s, d), folds.weekly_windows(s, END, 8))
    wide = b.groupBy("fold").pivot("model", ["all_history", "recent_7d"]).agg(F.max("map_at_k"))
    return r6(e.compare_folds(wide.select("fold", F.col("all_history").alias("base"), F.col("recent_7d").alias("arm"))), "base_mean", "arm_mean", "base_median", "arm_median", "mean_delta")


def _union_recall(s: SparkSession, d: str, cap: int = 50) -> DataFrame:
    union = merge.ordered_union(records(s, d), SOURCES, cap).select("customer_id", "article_id", F.col("position").alias("rank"))
    return metrics.retrieval_metrics(labels(s, d), union, (cap, 3 * cap))


def _by_bucket(s: SparkSession, d: str) -> DataFrame:
    ap = metrics.average_precision(labels(s, d), slates(s, d).select("customer_id", "article_id", "rank"))
    b = folds.history_buckets(customers(s, d), folds.before(transactions(s, d), CUTOFF))
    return r6(metrics.summarise(ap.join(b, "customer_id"), ["bucket"]), "map_at_k", "macro_recall_at_k", "micro_recall_at_k", "hit_rate_at_k")


def _segments(s: SparkSession, d: str) -> DataFrame:
    p = e.ranked_positives(scored(s, d), "lin").select("customer_id", "article_id", "rank", "item_purchases_30d", novelty(F.coalesce("times_bought_item", F.lit(0)), F.coalesce("affinity_product_type_name", F.lit(0.0))).alias("novelty"), source_count(F.col("num_sources")).alias("sources"))
    long = p.withColumn("x", F.explode(F.array(F.struct(F.lit("novelty").alias("dimension"), F.col("novelty").alias("segment")), F.struct(F.lit("sources").alias("dimension"), F.col("sources").alias("segment")))))
    return r6(e.rank_summary(long.select("rank", "x.dimension", "x.segment"), ["dimension", "segment"]), "p90_rank", "top_share")


def _tertiles(s: SparkSession, d: str) -> DataFrame:
    p = e.with_tertiles(e.ranked_positives(scored(s, d), "lin"), "item_purchases_30d", "popularity")
    return r6(e.rank_summary(p, ["popularity"]), "p90_rank", "top_share")


def _item_segments(s: SparkSession, d: str) -> DataFrame:
    seg = e.item_segments(transactions(s, d), articles(s, d), CUTOFF)
    pool = records(s, d).select("customer_id", "article_id")
    out = e.recall_by(labels(s, d), pool, seg.select("article_id", F.col("popularity").alias("segment")), "article_id")
    return r6(out.unionByName(e.recall_by(labels(s, d), pool, seg.select("article_id", F.col("age").alias("segment")), "article_id")), "recall")


def _dense(s: SparkSession, d: str) -> DataFrame:
    """Every pair of the candidate pool of which both have a vector."""
    v = table(s, d, "embeddings")
    pairs = records(s, d).select("customer_id", "article_id").distinct()
    return f.dense_scores(pairs, v.select(F.col("vec_id").alias("customer_id"), "embedding"), v.select(F.col("vec_id").alias("article_id"), "embedding"))


def _staged(s: SparkSession, df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: sampling, fitting and scoring read it instead of making the features again."""
    path = f"{shared_folder(s)}/scored-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return s.read.parquet(path)


def _ranker(kind: str, s: SparkSession, d: str) -> DataFrame:
    from larkspur.operators import rankers

    data = scored(s, d)
    if kind == "cross":
        data = data.join(articles(s, d).select("article_id", "product_type_name", "colour_group_name"), "article_id")
    data = _staged(s, data)
    cols = [x for x in f.feature_columns(SOURCES) if not x.startswith("rank_pct")]
    spec = {"trees": {"family": "trees"}, "pairwise": {"family": "pairwise"}, "net": {"family": "net"}, "cross": {"family": "cross", "options": {"categories": ["product_type_name", "colour_group_name"]}}, "list": {"family": "list"}}[kind]
    train = f.downsample(f.row_weights(data, "inv_sqrt_popularity"), F.col("num_sources").cast("double"), 20, 20, 7)
    if kind != "trees":
        train = train.drop("weight")
    return rankers.slate(rankers.fit_from_spec(train, cols, spec).score(data)).select("customer_id", "article_id", "rank")


def _metrics_of(s: SparkSession, d: str, slate: DataFrame) -> DataFrame:
    return metrics.ranking_metrics(labels(s, d), slate.select("customer_id", "article_id", "rank"), articles(s, d))


_M = ("map_at_k", "macro_recall_at_k", "micro_recall_at_k", "hit_rate_at_k")
_FEATURES = [x for x in f.feature_columns(SOURCES)]


def _f6(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return r6(df, *[x for x in df.columns if kinds[x] == "double"])


#: Columns that may be null; whole numbers among them are given as doubles.
_NULLABLE = ("rank_", "score", "affinity", "days_since", "times_bought")


def _doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({x: F.col(x).cast("double") for x in df.columns if x.startswith(_NULLABLE)})


QUERIES = {
    "popularity_baseline": lambda s, d: r6(popularity_baseline(transactions(s, d), articles(s, d), CUTOFF, START, END, 90), *_M, "coverage_at_k"),
    "popularity_baseline_all": lambda s, d: r6(popularity_baseline(transactions(s, d), articles(s, d), CUTOFF, START, END), *_M, "coverage_at_k"),
    "popularity_backtest": lambda s, d: r6(popularity_backtest(transactions(s, d), folds.weekly_windows(s, END, 8)), "map_at_k", "hit_rate_at_k"),
    "popularity_backtest_summary": _compare,
    "eligibility_ceiling": lambda s, d: r6(e.eligibility_ceiling(labels(s, d), c.popular_recent(transactions(s, d), CUTOFF, 90, 500)), "pair_ceiling", "customer_ceiling"),
    "standalone_recall": lambda s, d: _f6(metrics.retrieval_metrics(labels(s, d), records(s, d).withColumnRenamed("source_rank", "rank"), KS, ["source_name"])),
    "retrieval_coverage": lambda s, d: _f6(metrics.coverage(records(s, d).withColumnRenamed("source_rank", "rank"), articles(s, d), 300)),
    "union_recall": lambda s, d: _f6(_union_recall(s, d)),
    "marginal_recall": lambda s, d: r6(e.marginal_recall(labels(s, d), records(s, d), 500), "unique_share"),
    "pairwise_overlap": lambda s, d: r6(e.pairwise_overlap(records(s, d), 100), "jaccard"),
    "relevant_overlap": lambda s, d: r6(e.pairwise_overlap(records(s, d).join(labels(s, d), ["customer_id", "article_id"], "left_semi"), 500), "jaccard"),
    "incremental_union": lambda s, d: r6(e.incremental_union(labels(s, d), records(s, d), SOURCES, 500), "recall"),
    "oracle_map": lambda s, d: r6(metrics.oracle_map(labels(s, d), records(s, d)), "oracle_map"),
    "pool_metrics": lambda s, d: _f6(metrics.pool_metrics(labels(s, d), records(s, d))),
    "pair_features": lambda s, d: _f6(_doubles(base_features(s, d))),
    "affinity": lambda s, d: r6(f.affinities(transactions(s, d), articles(s, d), CUTOFF), "share"),
    "recency_frequency": lambda s, d: f.recency_frequency(transactions(s, d), articles(s, d), CUTOFF)["product_type"],
    "item_stats": lambda s, d: r6(f.item_stats(transactions(s, d), CUTOFF), "item_purchase_growth"),
    "feature_crosses": lambda s, d: _f6(f.crosses(base_features(s, d), "cooccurrence", "recent_pop").select("customer_id", "article_id", "cross_als_tt", "cross_tt_sources", "cross_sources_logpop", "cross_repeat_recency", "als_rank_minus_tt_rank", "min_als_tt_rank")),
    "labelled_pairs": lambda s, d: scored(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("num_sources").alias("sources")),
    "group_sizes": lambda s, d: f.groups(records(s, d).select("customer_id", "article_id").distinct()),
    "sample_weights": lambda s, d: r6(f.row_weights(scored(s, d), "inv_sqrt_popularity", "inv_sqrt_group_size").select("customer_id", "article_id", "weight"), "weight"),
    "history_weights": lambda s, d: r6(folds.history_buckets(customers(s, d), folds.before(transactions(s, d), CUTOFF)).select("customer_id", f.bucket_weight(F.col("bucket")).alias("weight")), "weight"),
    "normaliser_fit": lambda s, d: r6(f.fit_normaliser(base_features(s, d), [x for x in _FEATURES if x.startswith(("item_", "times_", "affinity_"))]), "mean", "std"),
    "dense_scores": lambda s, d: r6(_dense(s, d), "dense_score"),
    "group_ranks": lambda s, d: r6(f.group_ranks(scored(s, d).select("customer_id", "article_id", "lin"), "lin").drop("lin"), "group_pct"),
    "downsample": lambda s, d: f.downsample(scored(s, d), F.col("num_sources").cast("double"), 10, 10, 7).select("customer_id", "article_id", "label"),
    "map_at_k": lambda s, d: r6(metrics.average_precision(labels(s, d), slates(s, d).select("customer_id", "article_id", "rank")), "ap", "recall"),
    "ranking_metrics": lambda s, d: r6(_metrics_of(s, d, slates(s, d)), *_M, "coverage_at_k"),
    "ranking_metrics_by_bucket": _by_bucket,
    "segment_report": _segments,
    "popularity_tertiles": _tertiles,
    "item_segments": _item_segments,
    "rank_diagnostics": lambda s, d: _f6(e.describe(e.ranked_positives(scored(s, d), "lin"), "rank")),
    "feature_separability": lambda s, d: _f6(e.separability(scored(s, d), "lin", ["num_sources", "item_purchases_30d", "affinity_product_type_name", "times_bought_item"], F.col("item_purchases_30d") <= 5)),
    "score_diagnostics": lambda s, d: _f6(e.score_diagnostics(scored(s, d).withColumn("other", F.col("item_purchases_30d") * 0.1), "lin", "other")),
    "rank_gbt": lambda s, d: _ranker("trees", s, d),
    "rank_pairwise": lambda s, d: _ranker("pairwise", s, d),
    "rank_net": lambda s, d: _ranker("net", s, d),
    "rank_cross": lambda s, d: _ranker("cross", s, d),
    "rank_list": lambda s, d: _ranker("list", s, d),
}

# --------------------------------------------------------------------------- SQL

part("piv", "SELECT customer_id, article_id, " + ", ".join(f"count(*) FILTER (source_name = '{n}')::INT AS is_{n}, max(source_rank) FILTER (source_name = '{n}') AS rank_{n}, max(source_rank) FILTER (source_name = '{n}') / 500.0::DOUBLE AS rank_pct_{n}, max(source_score) FILTER (source_name = '{n}') AS score_{n}" for n in SOURCES) + ", count(*)::INT AS num_sources FROM rec GROUP BY 1, 2")
part("hcat", "SELECT customer_id, transaction_date, " + ", ".join(CATEGORIES) + " FROM hist JOIN art USING (article_id)")
part("aff", "SELECT customer_id, field, value, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY customer_id, field) AS share FROM (UNPIVOT (SELECT customer_id, " + ", ".join(CATEGORIES) + " FROM hcat) ON " + ", ".join(CATEGORIES) + " INTO NAME field VALUE value) WHERE value <> '' GROUP BY 1, 2, 3")
for _key, _col, _from in (("item", "article_id", "hist"), ("product_type", "product_type_name", "hcat"), ("garment_group", "garment_group_name", "hcat")):
    part(f"rf_{_key}", f"SELECT customer_id, {_col}, (DATE '{CUTOFF}' - max(transaction_date))::INT AS days, count(*) AS times FROM {_from} GROUP BY 1, 2")
_IN = lambda n: f"transaction_date BETWEEN DATE '{CUTOFF}' - {n - 1} AND DATE '{CUTOFF}'"
part("ist", f"SELECT article_id, p7, p30, ub, if(p30 > p7, p7::DOUBLE / greatest(p30 - p7, 1), 0) AS growth FROM (SELECT article_id, count(*) FILTER ({_IN(7)}) AS p7, count(*) AS p30, count(DISTINCT customer_id) AS ub FROM tx WHERE {_IN(30)} GROUP BY 1)")
part(
    "feat",
    "SELECT p.*, "
    + ", ".join(f"CASE WHEN h.customer_id IS NOT NULL THEN coalesce(a{i}.share, 0) END AS affinity_{x}" for i, x in enumerate(CATEGORIES))
    + ", " + ", ".join(f"CASE WHEN h.customer_id IS NOT NULL THEN coalesce(r_{k}.days, -1) END AS days_since_bought_{k}, CASE WHEN h.customer_id IS NOT NULL THEN coalesce(r_{k}.times, 0) END AS times_bought_{k}" for k in ("item", "product_type", "garment_group"))
    + ", coalesce(p7, 0) AS item_purchases_7d, coalesce(p30, 0) AS item_purchases_30d, coalesce(growth, 0) AS item_purchase_growth, coalesce(ub, 0) AS item_unique_buyers_30d"
    + " FROM piv p JOIN art USING (article_id) LEFT JOIN (SELECT DISTINCT customer_id FROM hist) h ON h.customer_id = p.customer_id"
    + "".join(f" LEFT JOIN aff a{i} ON a{i}.customer_id = p.customer_id AND a{i}.field = '{x}' AND a{i}.value = art.{x}" for i, x in enumerate(CATEGORIES))
    + " LEFT JOIN rf_item r_item ON r_item.customer_id = p.customer_id AND r_item.article_id = p.article_id"
    + "".join(f" LEFT JOIN rf_{k} r_{k} ON r_{k}.customer_id = p.customer_id AND r_{k}.{k}_name = art.{k}_name" for k in ("product_type", "garment_group"))
    + " LEFT JOIN ist ON ist.article_id = p.article_id",
)
part("scd", "SELECT feat.*, (l.article_id IS NOT NULL)::INT AS label, round(coalesce(score_repeat_purchase, 0) + coalesce(score_cooccurrence, 0) * 0.02::DOUBLE + item_purchases_30d * 0.01::DOUBLE + coalesce(affinity_product_type_name, 0) * 0.5::DOUBLE - coalesce(rank_recent_pop, 0) * 0.001::DOUBLE, 9) AS lin FROM feat LEFT JOIN lab l ON l.customer_id = feat.customer_id AND l.article_id = feat.article_id")
part("plc", "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY lin DESC, article_id) AS rank, count(*) OVER (PARTITION BY customer_id) AS pool FROM scd")
part("nrel", "SELECT customer_id, count(*) AS r FROM lab GROUP BY 1")
part("aps", "SELECT n.customer_id, n.r AS n_relevant, count(h.rank) AS hits, coalesce(sum(h.nth::DOUBLE / h.rank), 0) / least(n.r, 12) AS ap, count(h.rank)::DOUBLE / n.r AS recall FROM nrel n LEFT JOIN (SELECT customer_id, rank, row_number() OVER (PARTITION BY customer_id ORDER BY rank) AS nth FROM plc WHERE rank <= 12 AND label = 1) h ON h.customer_id = n.customer_id GROUP BY n.customer_id, n.r")
part("buc", "SELECT customer_id, CASE WHEN n > 20 THEN '20+' WHEN n > 10 THEN '11-20' WHEN n > 5 THEN '6-10' WHEN n > 2 THEN '3-5' WHEN n > 0 THEN '1-2' ELSE '0' END AS bucket FROM (SELECT c.customer_id, count(h.article_id) AS n FROM cust c LEFT JOIN hist h ON h.customer_id = c.customer_id GROUP BY 1)")
part("pospl", "SELECT *, CASE WHEN coalesce(times_bought_item, 0) > 0 THEN 'exact_repeat' WHEN coalesce(affinity_product_type_name, 0) > 0 THEN 'same_product_type' ELSE 'novel' END AS novelty, if(num_sources >= 4, '4+', num_sources::VARCHAR) AS sources FROM plc WHERE label = 1")
part("iseg", f"SELECT article_id, if(n >= quantile_cont(n::DOUBLE, 0.8) OVER (), 'popular', 'long_tail') AS popularity, CASE WHEN f > DATE '{CUTOFF}' - 90 THEN 'newer' WHEN f IS NOT NULL THEN 'established' ELSE 'unseen' END AS age FROM (SELECT a.article_id, count(h.article_id) AS n, min(h.transaction_date) AS f FROM art a LEFT JOIN hist h ON h.article_id = a.article_id GROUP BY 1)")
part("rpairs", "SELECT DISTINCT customer_id, article_id FROM rec")
part("bday", "SELECT transaction_date, article_id, count(*) AS n FROM tx GROUP BY 1, 2")
part("btop", "SELECT fold, model, article_id, row_number() OVER (PARTITION BY fold, model ORDER BY sum(n) DESC, article_id) AS rank FROM (SELECT fold, 'all_history' AS model, article_id, n FROM bday JOIN weekly ON transaction_date <= train_end UNION ALL SELECT fold, 'recent_7d', article_id, n FROM bday JOIN weekly ON transaction_date BETWEEN recent_start AND train_end) GROUP BY 1, 2, 3 QUALIFY rank <= 12")
part("blab", "SELECT DISTINCT fold, customer_id, article_id FROM tx JOIN weekly ON transaction_date BETWEEN target_start AND target_end")
part("bap", "SELECT m.fold, m.model, m.customer_id, coalesce(sum(nth::DOUBLE / rank), 0) / least(r, 12) AS ap, count(rank) AS h FROM (SELECT fold, customer_id, count(*) AS r, model FROM blab, (VALUES ('all_history'), ('recent_7d')) v(model) GROUP BY 1, 2, 4) m LEFT JOIN (SELECT l.fold, model, customer_id, rank, row_number() OVER (PARTITION BY l.fold, model, customer_id ORDER BY rank) AS nth FROM blab l JOIN btop t ON t.fold = l.fold AND t.article_id = l.article_id) x ON x.fold = m.fold AND x.model = m.model AND x.customer_id = m.customer_id GROUP BY m.fold, m.model, m.customer_id, r")
part("bres", "SELECT fold, model, count(*) AS customers, avg(ap) AS map_at_k, avg((h > 0)::INT) AS hit_rate_at_k FROM bap GROUP BY 1, 2")
part("poptop_all", "SELECT article_id, row_number() OVER (ORDER BY count(*) DESC, article_id) AS rank FROM hist GROUP BY 1 QUALIFY rank <= 12")
part("uni", "SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY min(list_position(['recent_pop', 'repeat_purchase', 'cooccurrence'], source_name) * 1000 + source_rank), article_id) AS rank FROM rec WHERE source_rank <= 50 GROUP BY 1, 2")


def _baseline(top: str) -> str:
    return (
        "SELECT segment, count(*) AS customers, round(avg(ap), 6) AS map_at_k, round(avg(h / r), 6) AS macro_recall_at_k, round(sum(h) / sum(r), 6) AS micro_recall_at_k, round(avg((h > 0)::INT), 6) AS hit_rate_at_k, "
        f"round((SELECT count(*) FROM {top}) / (SELECT count(*) FROM art)::DOUBLE, 6) AS coverage_at_k FROM (SELECT n.customer_id, n.r::DOUBLE AS r, count(rank)::DOUBLE AS h, coalesce(sum(nth::DOUBLE / rank), 0) / least(n.r, 12) AS ap, "
        "unnest(['overall', if(n.customer_id IN (SELECT customer_id FROM hist), 'warm', 'cold')]) AS segment FROM nrel n LEFT JOIN (SELECT customer_id, rank, row_number() OVER (PARTITION BY customer_id ORDER BY rank) AS nth "
        f"FROM lab JOIN {top} USING (article_id)) x ON x.customer_id = n.customer_id GROUP BY n.customer_id, n.r) GROUP BY segment"
    )


def _retrieval(ks: Sequence[int], table_: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    values = ", ".join(f"({k})" for k in ks)
    grid = f"(SELECT DISTINCT {by} FROM {table_}) g, " if by else ""
    on = f" AND t.{by} = x.{by}" if by else ""
    return (
        f"SELECT {g}k, count(*) AS customers, round(avg(h / r), 6) AS macro_recall, round(sum(h) / sum(r), 6) AS micro_recall, round(avg((h > 0)::INT), 6) AS hit_rate, sum(h)::BIGINT AS matched_pairs FROM ("
        f"SELECT {('x.' + by + ', ') if by else ''}x.k, x.customer_id, x.r::DOUBLE AS r, count(t.article_id)::DOUBLE AS h FROM (SELECT {g}k, n.customer_id, n.r FROM {grid}nrel n, (VALUES {values}) v(k)) x "
        f"LEFT JOIN (SELECT t.* FROM {table_} t SEMI JOIN lab USING (customer_id, article_id)) t ON t.customer_id = x.customer_id AND t.rank <= x.k{on} GROUP BY ALL) GROUP BY {g}k"
    )


part("pop500", f"SELECT article_id FROM (SELECT article_id, row_number() OVER (ORDER BY count(*) DESC, article_id) AS r FROM tx WHERE {_IN(90)} GROUP BY 1) WHERE r <= 500")
part("recr", "SELECT customer_id, article_id, source_name, source_rank AS rank FROM rec")
_SUM = "count(*) AS customers, round(avg(ap), 6) AS map_at_k, round(avg(recall), 6) AS macro_recall_at_k, round(sum(hits) / sum(n_relevant)::DOUBLE, 6) AS micro_recall_at_k, round(avg((hits > 0)::INT), 6) AS hit_rate_at_k"
_RANKS = "count(*) AS n, list_sort(list(rank))[count(*) // 2 + 1] AS median_rank, round(quantile_cont(rank::DOUBLE, 0.9), 6) AS p90_rank, round(avg((rank <= 12)::INT), 6) AS top_share"
_NUM = [x for x in _FEATURES if x.startswith(("item_", "times_", "affinity_"))]
_SEP = ["num_sources", "item_purchases_30d", "affinity_product_type_name", "times_bought_item"]


def _jaccard(table_: str, k: int) -> str:
    t = f"(SELECT * FROM {table_} WHERE source_rank <= {k})"
    size = f"(SELECT source_name, count(*) AS n FROM {t} GROUP BY 1)"
    shared = f"(SELECT x.source_name AS a, y.source_name AS b, count(*) AS c FROM {t} x JOIN {t} y USING (customer_id, article_id) GROUP BY 1, 2)"
    return f"SELECT p.source_name AS source_a, q.source_name AS source_b, coalesce(c, 0) AS shared, round(coalesce(c, 0)::DOUBLE / (p.n + q.n - coalesce(c, 0)), 6) AS jaccard FROM {size} p CROSS JOIN {size} q LEFT JOIN {shared} s ON s.a = p.source_name AND s.b = q.source_name"


part("rechit", "SELECT rec.* FROM rec SEMI JOIN lab USING (customer_id, article_id)")
_NAMES = "['" + "', '".join(SOURCES) + "']"

ORACLES = {k: compose(v) for k, v in {
    "popularity_baseline": _baseline("(SELECT article_id, rank FROM pop90 WHERE rank <= 12)"),
    "popularity_baseline_all": _baseline("poptop_all"),
    "popularity_backtest": "SELECT fold, model, customers, round(map_at_k, 6) AS map_at_k, round(hit_rate_at_k, 6) AS hit_rate_at_k FROM bres",
    "popularity_backtest_summary": "SELECT count(*) AS folds, round(avg(a.map_at_k), 6) AS base_mean, round(avg(b.map_at_k), 6) AS arm_mean, round(median(a.map_at_k), 6) AS base_median, round(median(b.map_at_k), 6) AS arm_median, round(avg(b.map_at_k - a.map_at_k), 6) AS mean_delta, count(*) FILTER (b.map_at_k - a.map_at_k > 1e-12) AS wins, count(*) FILTER (abs(b.map_at_k - a.map_at_k) <= 1e-12) AS ties, count(*) FILTER (b.map_at_k - a.map_at_k < -1e-12) AS losses FROM bres a JOIN bres b ON a.fold = b.fold AND a.model = 'all_history' AND b.model = 'recent_7d'",
    "eligibility_ceiling": "SELECT *, round(reachable_pairs / pairs::DOUBLE, 6) AS pair_ceiling, round(reachable_customers / customers::DOUBLE, 6) AS customer_ceiling FROM (SELECT count(*) AS pairs, count(DISTINCT customer_id) AS customers, count(*) FILTER (article_id IN (SELECT article_id FROM pop500)) AS reachable_pairs, count(DISTINCT customer_id) FILTER (article_id IN (SELECT article_id FROM pop500)) AS reachable_customers FROM lab)",
    "standalone_recall": _retrieval(KS, "recr", "source_name"),
    "retrieval_coverage": "SELECT round(count(DISTINCT article_id) / (SELECT count(*) FROM art)::DOUBLE, 6) AS coverage FROM rec WHERE source_rank <= 300",
    "union_recall": _retrieval((50, 150), "uni"),
    "marginal_recall": "SELECT source_name, count(*) AS hits, count(*) FILTER (n = 1) AS unique_hits, count(*) FILTER (n > 1) AS shared_hits, round(count(*) FILTER (n = 1) / count(*)::DOUBLE, 6) AS unique_share FROM (SELECT *, count(*) OVER (PARTITION BY customer_id, article_id) AS n FROM rechit) GROUP BY 1",
    "pairwise_overlap": _jaccard("rec", 100),
    "relevant_overlap": _jaccard("rechit", 500),
    "incremental_union": f"SELECT step, {_NAMES}[step + 1] AS source_name, new_pairs, new_hits, sum(new_pairs) OVER (ORDER BY step)::BIGINT AS pool_pairs, sum(new_hits) OVER (ORDER BY step)::BIGINT AS hits, round(sum(new_hits) OVER (ORDER BY step) / (SELECT count(*) FROM lab)::DOUBLE, 6) AS recall FROM (SELECT step, count(*) AS new_pairs, count(*) FILTER (hit) AS new_hits FROM (SELECT customer_id, article_id, min(list_position({_NAMES}, source_name) - 1)::BIGINT AS step, (customer_id, article_id) IN (SELECT (customer_id, article_id) FROM lab) AS hit FROM rec GROUP BY 1, 2) GROUP BY 1)",
    "oracle_map": "SELECT round(avg(least(h, 12) / least(r, 12)::DOUBLE), 6) AS oracle_map, count(*) AS customers FROM (SELECT n.customer_id, r, count(p.article_id) AS h FROM nrel n LEFT JOIN (SELECT rpairs.* FROM rpairs SEMI JOIN lab USING (customer_id, article_id)) p ON p.customer_id = n.customer_id GROUP BY 1, 2)",
    "pool_metrics": "SELECT count(*) AS customers, round(sum(h) / sum(r)::DOUBLE, 6) AS micro_recall, round(avg(h / r::DOUBLE), 6) AS macro_recall, round(avg((h > 0)::INT), 6) AS hit_rate, round(avg(m), 6) AS mean_pool FROM (SELECT n.customer_id, r, count(p.article_id) AS m, count(l.article_id) AS h FROM nrel n LEFT JOIN rpairs p ON p.customer_id = n.customer_id LEFT JOIN lab l ON l.customer_id = p.customer_id AND l.article_id = p.article_id GROUP BY 1, 2)",
    "pair_features": "SELECT customer_id, article_id, " + ", ".join(f"round({x}::DOUBLE, 6) AS {x}" if x.startswith(_NULLABLE) or x == "item_purchase_growth" else x for x in _FEATURES) + " FROM feat",
    "affinity": "SELECT customer_id, field, value, round(share, 6) AS share FROM aff",
    "recency_frequency": "SELECT customer_id, product_type_name, days AS days_since_bought_product_type, times AS times_bought_product_type FROM rf_product_type",
    "item_stats": "SELECT article_id, p7 AS item_purchases_7d, p30 AS item_purchases_30d, ub AS item_unique_buyers_30d, round(growth, 6) AS item_purchase_growth FROM ist",
    "feature_crosses": "SELECT customer_id, article_id, round(coalesce(score_cooccurrence, 0) * coalesce(score_recent_pop, 0), 6) AS cross_als_tt, round(coalesce(score_recent_pop, 0) * num_sources, 6) AS cross_tt_sources, round(num_sources * ln(1 + item_purchases_30d), 6) AS cross_sources_logpop, round(coalesce(score_repeat_purchase, 0) / (1 + greatest(coalesce(days_since_bought_item, 365), 0)), 6) AS cross_repeat_recency, round((coalesce(rank_cooccurrence, 500) - coalesce(rank_recent_pop, 500))::DOUBLE, 6) AS als_rank_minus_tt_rank, least(coalesce(rank_cooccurrence, 500), coalesce(rank_recent_pop, 500))::DOUBLE AS min_als_tt_rank FROM feat",
    "labelled_pairs": "SELECT label, count(*) AS n, sum(num_sources)::BIGINT AS sources FROM scd GROUP BY 1",
    "group_sizes": "SELECT customer_id, count(*) AS group_size FROM rpairs GROUP BY 1",
    "sample_weights": "SELECT customer_id, article_id, round(greatest(0.25, least(4, if(label = 1, 1 / sqrt(greatest(item_purchases_30d, 1)), 1))) / sqrt(pool), 6) AS weight FROM plc",
    "history_weights": "SELECT customer_id, round(1 / sqrt(1 + CASE bucket WHEN '0' THEN 0 WHEN '1-2' THEN 1.5 WHEN '3-5' THEN 4 WHEN '6-10' THEN 8 WHEN '11-20' THEN 15.5 ELSE 25 END::DOUBLE), 6) AS weight FROM buc",
    "normaliser_fit": " UNION ALL ".join("SELECT '{0}' AS feature, round(avg(v), 6) AS mean, round(if(stddev_pop(v) < 1e-6, 1, stddev_pop(v)), 6) AS std FROM (SELECT {1} AS v FROM feat)".format(x, f"ln(1 + greatest(coalesce({x}, 0), 0))" if x in f.LOGGED else f"coalesce({x}, 0)::DOUBLE") for x in _NUM),
    "dense_scores": "SELECT customer_id, article_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dense_score FROM rpairs JOIN embeddings a ON a.vec_id = customer_id JOIN embeddings b ON b.vec_id = article_id",
    "group_ranks": "SELECT customer_id, article_id, rank AS group_rank, round(rank / pool::DOUBLE, 6) AS group_pct FROM plc",
    "map_at_k": "SELECT customer_id, n_relevant, hits, round(ap, 6) AS ap, round(recall, 6) AS recall FROM aps",
    "ranking_metrics": f"SELECT {_SUM}, round((SELECT count(DISTINCT article_id) FROM plc WHERE rank <= 12) / (SELECT count(*) FROM art)::DOUBLE, 6) AS coverage_at_k FROM aps",
    "ranking_metrics_by_bucket": f"SELECT bucket, {_SUM} FROM aps JOIN buc USING (customer_id) GROUP BY bucket",
    "segment_report": f"SELECT 'novelty' AS dimension, novelty AS segment, {_RANKS} FROM pospl GROUP BY 2 UNION ALL SELECT 'sources', sources, {_RANKS} FROM pospl GROUP BY 2",
    "popularity_tertiles": f"SELECT popularity, {_RANKS} FROM (SELECT rank, CASE WHEN item_purchases_30d <= quantile_cont(item_purchases_30d::DOUBLE, 0.3333333333333333) OVER () THEN 'long_tail' WHEN item_purchases_30d <= quantile_cont(item_purchases_30d::DOUBLE, 0.6666666666666666) OVER () THEN 'medium' ELSE 'head' END AS popularity FROM pospl) GROUP BY 1",
    "item_segments": "SELECT segment, count(*) AS pairs, count(p.article_id) AS hits, round(count(p.article_id) / count(*)::DOUBLE, 6) AS recall FROM (SELECT customer_id, article_id, unnest([popularity, age]) AS segment FROM lab JOIN iseg USING (article_id)) l LEFT JOIN rpairs p ON p.customer_id = l.customer_id AND p.article_id = l.article_id GROUP BY 1",
    "downsample": "SELECT customer_id, article_id, label FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, label, h > 10 ORDER BY md5('7:' || customer_id || ':' || article_id), article_id) AS r FROM "
    "(SELECT customer_id, article_id, label, row_number() OVER (PARTITION BY customer_id, label ORDER BY num_sources DESC, article_id) AS h FROM scd)) WHERE label = 1 OR h <= 10 OR r <= 10",
    "rank_diagnostics": "SELECT count(*) AS n, round(avg(rank), 6) AS mean, round(median(rank), 6) AS median, " + ", ".join(f"round(quantile_cont(rank::DOUBLE, {q / 100}), 6) AS p{q}" for q in (10, 25, 75, 90)) + " FROM pospl",
    "feature_separability": " UNION ALL ".join(f"SELECT '{x}' AS feature, round(avg(coalesce({x}, 0)) FILTER (label = 1 AND r > 12), 6) AS buried_mean, round(avg(coalesce({x}, 0)) FILTER (label = 0 AND r <= 12), 6) AS shown_mean, count(*) FILTER (label = 1 AND r > 12) AS n_buried, count(*) FILTER (label = 0 AND r <= 12) AS n_shown FROM (SELECT *, rank AS r FROM plc) WHERE item_purchases_30d <= 5" for x in _SEP),
    "score_diagnostics": "SELECT round(avg(lin) FILTER (label = 1), 6) AS positive_mean, round(avg(lin) FILTER (label = 0), 6) AS negative_mean, round(avg(abs(lin - item_purchases_30d * 0.1::DOUBLE)), 6) AS mean_abs_diff, round(max(abs(lin - item_purchases_30d * 0.1::DOUBLE)), 6) AS max_abs_diff, round(corr(lin, item_purchases_30d * 0.1::DOUBLE), 6) AS correlation FROM scd",
}.items()}

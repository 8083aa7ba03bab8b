"""Registered candidate sources, protocol steps and merges, with SQL for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import candidates as c
from larkspur.operators import features as f
from larkspur.operators import folds, merge, vectors
from larkspur.plans.sql import CUTOFF, END, START, compose, part
from larkspur.sources.relations import CATEGORIES, articles, customers, table, transactions

SOURCES = ("recent_pop", "repeat_purchase", "cooccurrence")
POP_DAYS, PAIR_DAYS, MIN_PAIRS = 90, 720, 2


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({x: F.round(x, 6) for x in columns})


def labels(s: SparkSession, d: str) -> DataFrame:
    return folds.labels(transactions(s, d), START, END)


def records(s: SparkSession, d: str) -> DataFrame:
    """The long candidate table of the three exact sources, for the customers with labels."""
    tx, who = transactions(s, d), labels(s, d).select("customer_id").distinct()
    found = {
        "recent_pop": c.for_everyone(c.popular_recent(tx, CUTOFF, POP_DAYS, 100), who),
        "repeat_purchase": c.repeat_purchase(tx, who, CUTOFF),
        "cooccurrence": c.copurchase(tx, who, CUTOFF, PAIR_DAYS, min_count=MIN_PAIRS),
    }
    return reduce(DataFrame.unionByName, [c.as_records(found[n], n, CUTOFF) for n in SOURCES])


def _embeddings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("article_id"), "embedding", "label", F.when(F.exists("embedding", lambda x: x != 0), 1).otherwise(2).alias("status"))


def _users(s: SparkSession, d: str) -> DataFrame:
    """Every vector as a query."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("customer_id"), "embedding")


def _exact(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    return vectors.exact_neighbours(_users(s, d), _embeddings(s, d).filter("status = 1"), k)


def _ivf(s: SparkSession, d: str) -> DataFrame:
    return vectors.CellIndex(_embeddings(s, d).filter("status = 1"), cells=16, probes=12).search(_users(s, d), 10)


def _image_profiles(s: SparkSession, d: str) -> DataFrame:
    return vectors.visual_profiles(transactions(s, d), _embeddings(s, d), labels(s, d), CUTOFF)


def _image_candidates(s: SparkSession, d: str) -> DataFrame:
    tx, items = transactions(s, d), _embeddings(s, d)
    users = vectors.as_vectors(_image_profiles(s, d))
    owned = folds.before(tx, CUTOFF).select("customer_id", "article_id")
    pool = vectors.exact_neighbours(users, vectors.eligible_items(tx, items, CUTOFF), 200)
    return vectors.drop_owned(pool, owned, 20)


def _als(s: SparkSession, d: str) -> DataFrame:
    return c.als(transactions(s, d), labels(s, d), CUTOFF)


def _two_tower(s: SparkSession, d: str) -> DataFrame:
    from larkspur.operators.rankers import two_tower_candidates

    return two_tower_candidates(transactions(s, d), articles(s, d), labels(s, d), CUTOFF)


def _budgeted(s: SparkSession, d: str) -> DataFrame:
    from larkspur.plans.evaluation import base_features

    out = merge.apply_budget(base_features(s, d), SOURCES, "cooccurrence", 20, {"recent_pop": 50})
    return out.select("customer_id", "article_id", *[x for n in SOURCES for x in (f"is_{n}", F.col(f"rank_{n}").cast("double").alias(f"rank_{n}"))], "num_sources")


def _sweep(s: SparkSession, d: str) -> DataFrame:
    """(fold, budget, map, hits, candidates): oracle figures of the pool at several budgets, folds being customers by remainder of 3."""
    rec, lab = records(s, d), labels(s, d)
    budgets = s.createDataFrame([(b,) for b in (0, 10, 50, 100)], "budget int")
    fold = (F.col("customer_id") % 3).cast("long")
    kept = rec.join(F.broadcast(budgets), (F.col("source_name") != "cooccurrence") | (F.col("source_rank") <= F.col("budget")))
    pool = kept.select("budget", "customer_id", "article_id").distinct()
    size = pool.groupBy("budget", "customer_id").agg(F.count(F.lit(1)).alias("n"))
    hits = pool.join(lab, ["customer_id", "article_id"], "left_semi").groupBy("budget", "customer_id").agg(F.count(F.lit(1)).alias("h"))
    rel = lab.groupBy("customer_id").agg(F.count(F.lit(1)).alias("r")).crossJoin(F.broadcast(budgets))
    all_ = rel.join(size, ["budget", "customer_id"], "left").join(hits, ["budget", "customer_id"], "left").na.fill(0)
    return all_.groupBy(fold.alias("fold"), "budget").agg(F.avg(F.least("h", F.lit(12)) / F.least("r", F.lit(12))).alias("map"), F.sum("h").alias("hits"), F.sum("n").alias("candidates"))


QUERIES = {
    "weekly_windows": lambda s, d: folds.weekly_windows(s, END, 8),
    "weekly_populations": lambda s, d: folds.fold_populations(transactions(s, d), folds.weekly_windows(s, END, 8)),
    "customer_sample_first_n": lambda s, d: folds.first_customers(labels(s, d), 50),
    "customer_sample_hashed": lambda s, d: folds.hashed_sample(customers(s, d), 100, 42),
    "holdout_pool": lambda s, d: folds.holdout_pool(customers(s, d), labels(s, d), customers(s, d).filter("customer_id % 5 = 0")),
    "eligible_articles": lambda s, d: folds.eligible_articles(articles(s, d), "observed_before_cutoff", transactions(s, d).filter(F.col("transaction_date") <= F.lit("1995-06-30").cast("date"))),
    "labels": lambda s, d: labels(s, d),
    "warm_cold_labels": lambda s, d: folds.warm_cold(folds.labels(transactions(s, d), "1995-07-01", "1995-07-28"), transactions(s, d).filter("transaction_date <= DATE '1995-06-30'")),
    "history_buckets": lambda s, d: folds.history_buckets(customers(s, d), folds.before(transactions(s, d), CUTOFF)),
    "pop_all_history": lambda s, d: c.popular_all_history(transactions(s, d), CUTOFF),
    "pop_recent": lambda s, d: c.popular_recent(transactions(s, d), CUTOFF),
    "pop_decayed": lambda s, d: r6(c.popular_decayed(transactions(s, d), CUTOFF), "score"),
    "pop_broadcast": lambda s, d: c.for_everyone(c.popular_recent(transactions(s, d), CUTOFF, POP_DAYS, 20), labels(s, d)).select("customer_id", "article_id", "source_rank"),
    "repeat_purchase": lambda s, d: r6(c.repeat_purchase(transactions(s, d), labels(s, d), CUTOFF), "source_score"),
    "cooccurrence_pairs": lambda s, d: r6(c.copurchase_pairs(transactions(s, d), CUTOFF, PAIR_DAYS, MIN_PAIRS), "pmi"),
    "cooccurrence_neighbors": lambda s, d: r6(c.neighbours(c.copurchase_pairs(transactions(s, d), CUTOFF, PAIR_DAYS, MIN_PAIRS)), "pmi"),
    "cooccurrence_candidates": lambda s, d: r6(c.copurchase(transactions(s, d), labels(s, d), CUTOFF, PAIR_DAYS, min_count=MIN_PAIRS), "source_score"),
    "content_vectors": lambda s, d: r6(c.article_tokens(articles(s, d)), "weight"),
    "content_profiles": lambda s, d: r6(c.content_profiles(transactions(s, d), labels(s, d), c.article_tokens(articles(s, d)), CUTOFF), "weight"),
    "content_candidates": lambda s, d: r6(c.content(transactions(s, d), labels(s, d), articles(s, d), CUTOFF, k=50), "source_score"),
    "user_numeric_features": lambda s, d: r6(f.user_numeric(transactions(s, d), customers(s, d), CUTOFF), "n", "n_articles", "price_mean", "price_std", "channel2_share", "span_days", "days_since_last"),
    "history_topn": lambda s, d: f.latest_history(transactions(s, d), CUTOFF, 10).select("customer_id", "position", "transaction_date", "article_id"),
    "catalog_vocab": lambda s, d: f.vocabulary(articles(s, d), CATEGORIES),
    "als_candidates": _als,
    "two_tower_candidates": _two_tower,
    "ann_exact_topk": lambda s, d: r6(_exact(s, d), "source_score"),
    "ann_ivf": _ivf,
    "ann_diagnostics": lambda s, d: vectors.compare_neighbours(_ivf(s, d), _exact(s, d), 10),
    "embedding_norms": lambda s, d: r6(vectors.norm_summary(_embeddings(s, d)), "minimum", "mean", "maximum", "std"),
    "image_profiles": lambda s, d: _image_profiles(s, d).select("customer_id", F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value")),
    "image_candidates": lambda s, d: r6(_image_candidates(s, d), "source_score"),
    "candidate_records": lambda s, d: r6(records(s, d), "source_score").drop("model_version"),
    "candidate_merge": lambda s, d: merge.merge_records(records(s, d)).withColumn("source_names", F.array_join("source_names", ",")),
    "candidate_union": lambda s, d: merge.ordered_union(records(s, d), SOURCES, 50).select("customer_id", "article_id", "position"),
    "candidate_lists": lambda s, d: merge.article_lists(merge.merge_records(records(s, d).filter("source_rank <= 10"))).select("customer_id", F.array_join(F.col("article_ids").cast("array<string>"), " ").alias("article_ids")),
    "source_attribution": lambda s, d: c.source_attribution(records(s, d), list(SOURCES)),
    "apply_budget": _budgeted,
    "budget_sweep": lambda s, d: r6(_sweep(s, d), "map"),
    "budget_choice": lambda s, d: r6(merge.choose_budget(_sweep(s, d)), "best_map"),
    "budget_efficiency": lambda s, d: r6(merge.budget_efficiency(_sweep(s, d)), "hits_per_10k"),
}

# --------------------------------------------------------------------------- SQL


def _decay(half_life: float) -> str:
    return f"exp(-ln(2.0::DOUBLE) / {half_life} * (DATE '{CUTOFF}' - transaction_date))"


def _window(days: int) -> str:
    return f"transaction_date BETWEEN DATE '{CUTOFF}' - {days - 1} AND DATE '{CUTOFF}'"


def _rank(score: str, by: str = "", ident: str = "article_id") -> str:
    return f"row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY round({score}, 9) DESC, {ident})"


def _pop(score: str, where: str, k: int) -> str:
    return f"SELECT article_id, score, rank FROM (SELECT *, {_rank('score')} AS rank FROM (SELECT article_id, {score} AS score FROM tx WHERE {where} GROUP BY article_id)) WHERE rank <= {k}"


_SEEN = f"transaction_date <= DATE '{CUTOFF}'"
part("weeks", f"SELECT i + 1 AS fold, DATE '{END}' - ((7 - i) * 7)::INT AS target_end FROM range(8) r(i)")
part("weekly", "SELECT fold, target_end - 7 AS train_end, target_end - 13 AS recent_start, target_end - 6 AS target_start, target_end FROM weeks")
part("pop90", _pop("count(*)::DOUBLE", _window(POP_DAYS), 100))
part("rep", f"SELECT customer_id, article_id, sum({_decay(30.0)}) AS s FROM hist SEMI JOIN who USING (customer_id) GROUP BY ALL")
part("rep_ranked", f"SELECT customer_id, article_id, s AS source_score, {_rank('s', 'customer_id')} AS source_rank FROM rep QUALIFY source_rank <= 500")
part("win", f"SELECT customer_id, transaction_date, article_id FROM tx WHERE {_window(PAIR_DAYS)}")
part("raw_pairs", f"SELECT x.article_id AS a, y.article_id AS b, count(*) AS n FROM win x JOIN win y ON x.customer_id = y.customer_id AND x.transaction_date = y.transaction_date AND x.article_id < y.article_id GROUP BY 1, 2 HAVING count(*) >= {MIN_PAIRS}")
part("frq", "SELECT article_id, count(*) AS f FROM win GROUP BY 1")
part("prs", "SELECT a, b, n, ln(n * (SELECT count(*)::DOUBLE FROM win) / (x.f::DOUBLE * y.f)) AS pmi FROM raw_pairs JOIN frq x ON x.article_id = a JOIN frq y ON y.article_id = b")
part("nbr", f"SELECT seed, article_id, pmi, {_rank('pmi', 'seed')} AS rank FROM (SELECT a AS seed, b AS article_id, pmi FROM prs UNION ALL SELECT b, a, pmi FROM prs) QUALIFY rank <= 50")
part("coo", "SELECT o.customer_id, n.article_id, sum(pmi) AS s FROM owned o SEMI JOIN who USING (customer_id) JOIN nbr n ON n.seed = o.article_id GROUP BY ALL")
part("coo_ranked", f"SELECT customer_id, article_id, s AS source_score, {_rank('s', 'customer_id')} AS source_rank FROM coo ANTI JOIN owned USING (customer_id, article_id) QUALIFY source_rank <= 500")
part("rec", f"SELECT customer_id, article_id, 'recent_pop' AS source_name, rank::INT AS source_rank, score AS source_score, DATE '{CUTOFF}' AS feature_cutoff FROM who, pop90 UNION ALL SELECT customer_id, article_id, 'repeat_purchase', source_rank::INT, source_score, DATE '{CUTOFF}' FROM rep_ranked UNION ALL SELECT customer_id, article_id, 'cooccurrence', source_rank::INT, source_score, DATE '{CUTOFF}' FROM coo_ranked")
part("ato", "SELECT article_id, field || '=' || trim(value) AS token, 1 / sqrt(count(*) OVER (PARTITION BY article_id)) AS weight FROM (UNPIVOT (SELECT article_id, " + ", ".join(CATEGORIES) + " FROM art) ON " + ", ".join(CATEGORIES) + " INTO NAME field VALUE value) WHERE trim(value) <> ''")
part("bought", f"SELECT customer_id, article_id, sum({_decay(90.0)}) AS w FROM hist SEMI JOIN who USING (customer_id) GROUP BY ALL")
part("prof_raw", "SELECT customer_id, token, sum(w * weight) AS raw FROM bought JOIN ato USING (article_id) GROUP BY ALL")
part("prof", "SELECT customer_id, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY customer_id)) AS weight FROM prof_raw")
part("cos", "SELECT p.customer_id, t.article_id, sum(p.weight * t.weight) AS s FROM prof p JOIN ato t USING (token) GROUP BY ALL")
part("cos_top", f"SELECT * FROM cos QUALIFY {_rank('s', 'customer_id')} <= 150")
part("emb", "SELECT vec_id AS article_id, embedding::DOUBLE[] AS e, CASE WHEN list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 THEN 1 ELSE 2 END AS status FROM embeddings")
part("emb_q", "SELECT vec_id AS customer_id, embedding::DOUBLE[] AS e FROM embeddings")
part("lastbuy", f"SELECT customer_id, article_id, max(transaction_date) AS day FROM hist SEMI JOIN who USING (customer_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY max(transaction_date) DESC, article_id) <= 50")
part("imgcell", f"SELECT customer_id, exp(-ln(2.0::DOUBLE) / 45.0 * (DATE '{CUTOFF}' - day)) AS w, unnest(e) AS x, unnest(range(len(e))) AS position FROM lastbuy JOIN emb USING (article_id) WHERE status = 1")
part("imgmean", "SELECT customer_id, position, sum(w * x) / sum(w) AS m FROM imgcell GROUP BY ALL")
part("imgprof", "SELECT customer_id, position, m / sqrt(sum(m * m) OVER (PARTITION BY customer_id)) AS value FROM imgmean")
part("imgitem", "SELECT article_id, unnest(e) AS x, unnest(range(len(e))) AS position FROM emb WHERE status = 1 AND article_id IN (SELECT article_id FROM hist)")
part("imgscore", "SELECT customer_id, i.article_id, sum(value * x) AS s FROM imgprof JOIN imgitem i USING (position) GROUP BY ALL")
part("imgpool", f"SELECT * FROM imgscore QUALIFY {_rank('s', 'customer_id')} <= 200")
part("sweep", "SELECT (r.customer_id % 3)::BIGINT AS fold, r.budget, avg(least(coalesce(h, 0), 12) / least(r.r, 12)) AS map, sum(coalesce(h, 0))::BIGINT AS hits, sum(coalesce(n, 0))::BIGINT AS candidates FROM (SELECT customer_id, count(*) AS r, b.budget FROM lab, (VALUES (0), (10), (50), (100)) b(budget) GROUP BY ALL) r LEFT JOIN (SELECT customer_id, budget, count(*) AS n, count(*) FILTER ((customer_id, article_id) IN (SELECT (customer_id, article_id) FROM lab)) AS h FROM (SELECT DISTINCT customer_id, article_id, budget FROM rec, (VALUES (0), (10), (50), (100)) b(budget) WHERE source_name <> 'cooccurrence' OR source_rank <= budget) GROUP BY ALL) p ON p.customer_id = r.customer_id AND p.budget = r.budget GROUP BY 1, 2")

ORACLES = {k: compose(v) for k, v in {
    "weekly_windows": "SELECT * FROM weekly",
    "weekly_populations": "SELECT fold, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, count(DISTINCT article_id) AS n_articles FROM tx JOIN weekly ON transaction_date BETWEEN target_start AND target_end GROUP BY fold",
    "customer_sample_first_n": "SELECT customer_id FROM who ORDER BY 1 LIMIT 50",
    "holdout_pool": "SELECT DISTINCT customer_id FROM cust WHERE customer_id % 5 <> 0 AND customer_id NOT IN (SELECT customer_id FROM lab)",
    "eligible_articles": "SELECT article_id FROM art WHERE article_id IN (SELECT article_id FROM tx WHERE transaction_date <= DATE '1995-06-30')",
    "labels": "SELECT * FROM lab",
    "warm_cold_labels": "SELECT customer_id, count(DISTINCT article_id) AS n_labels, customer_id NOT IN (SELECT customer_id FROM tx WHERE transaction_date <= DATE '1995-06-30') AS is_cold_customer FROM tx WHERE transaction_date BETWEEN DATE '1995-07-01' AND DATE '1995-07-28' GROUP BY 1",
    "history_buckets": "SELECT customer_id, n AS n_history, CASE WHEN n > 20 THEN '20+' WHEN n > 10 THEN '11-20' WHEN n > 5 THEN '6-10' WHEN n > 2 THEN '3-5' WHEN n > 0 THEN '1-2' ELSE '0' END AS bucket FROM (SELECT c.customer_id, count(h.article_id) AS n FROM cust c LEFT JOIN hist h ON h.customer_id = c.customer_id GROUP BY 1)",
    "pop_all_history": _pop("count(*)::DOUBLE", _SEEN, 500),
    "pop_recent": _pop("count(*)::DOUBLE", _window(7), 500),
    "pop_decayed": f"SELECT article_id, round(score, 6) AS score, rank FROM ({_pop(f'sum({_decay(14.0)})', _SEEN, 500)})",
    "pop_broadcast": "SELECT customer_id, article_id, rank AS source_rank FROM who, pop90 WHERE rank <= 20",
    "repeat_purchase": "SELECT customer_id, article_id, round(source_score, 6) AS source_score, source_rank FROM rep_ranked",
    "cooccurrence_pairs": "SELECT a, b, n, round(pmi, 6) AS pmi FROM prs",
    "cooccurrence_neighbors": "SELECT seed, article_id, round(pmi, 6) AS pmi, rank FROM nbr",
    "cooccurrence_candidates": "SELECT customer_id, article_id, round(source_score, 6) AS source_score, source_rank FROM coo_ranked",
    "content_vectors": "SELECT article_id, token, round(weight, 6) AS weight FROM ato",
    "content_profiles": "SELECT customer_id, token, round(weight, 6) AS weight FROM prof",
    "content_candidates": f"SELECT customer_id, article_id, round(s, 6) AS source_score, {_rank('s', 'customer_id')} AS source_rank FROM cos_top ANTI JOIN owned USING (customer_id, article_id) QUALIFY source_rank <= 50",
    "user_numeric_features": f"SELECT c.customer_id, round(ln(1 + count(h.article_id)), 6) AS n, round(ln(1 + count(DISTINCT h.article_id)), 6) AS n_articles, round(ln(1 + coalesce(avg(price), 0)), 6) AS price_mean, round(ln(1 + coalesce(stddev_pop(price), 0)), 6) AS price_std, round(coalesce(avg((sales_channel_id = 2)::INT), 0), 6) AS channel2_share, round(ln(1 + coalesce(max(transaction_date) - min(transaction_date), 0)), 6) AS span_days, round(ln(1 + coalesce(DATE '{CUTOFF}' - max(transaction_date), 0)), 6) AS days_since_last FROM (SELECT DISTINCT customer_id FROM cust) c LEFT JOIN hist h ON h.customer_id = c.customer_id GROUP BY 1",
    "history_topn": "SELECT customer_id, transaction_date, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY transaction_date DESC, article_id, price) AS position FROM hist QUALIFY position <= 10",
    "catalog_vocab": "SELECT field, value, dense_rank() OVER (PARTITION BY field ORDER BY value) AS index FROM (SELECT DISTINCT field, trim(value) AS value FROM (UNPIVOT (SELECT " + ", ".join(CATEGORIES) + " FROM art) ON " + ", ".join(CATEGORIES) + " INTO NAME field VALUE value)) WHERE value <> ''",
    "ann_exact_topk": f"SELECT customer_id, article_id, round(s, 6) AS source_score, {_rank('s', 'customer_id')} AS source_rank FROM (SELECT q.customer_id, i.article_id, list_inner_product(q.e, i.e) AS s FROM emb_q q, emb i WHERE status = 1) QUALIFY source_rank <= 10",
    "embedding_norms": "SELECT count(*) AS vectors, round(min(n), 6) AS minimum, round(avg(n), 6) AS mean, round(max(n), 6) AS maximum, round(stddev_pop(n), 6) AS std FROM (SELECT sqrt(list_inner_product(e, e)) AS n FROM emb)",
    "image_profiles": "SELECT customer_id, position, round(value, 6) AS value FROM imgprof",
    "image_candidates": f"SELECT customer_id, article_id, round(s, 6) AS source_score, {_rank('s', 'customer_id')} AS source_rank FROM imgpool ANTI JOIN owned USING (customer_id, article_id) QUALIFY source_rank <= 20",
    "candidate_records": "SELECT customer_id, article_id, source_name, source_rank, round(source_score, 6) AS source_score, feature_cutoff FROM rec",
    "candidate_merge": "SELECT customer_id, article_id, min(source_rank) AS best_rank, string_agg(source_name, ',' ORDER BY source_name) AS source_names, count(*) AS num_sources, row_number() OVER (PARTITION BY customer_id ORDER BY min(source_rank), article_id) AS position FROM rec GROUP BY 1, 2",
    "candidate_union": "SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY min(o), article_id) AS position FROM (SELECT customer_id, article_id, list_position(['recent_pop', 'repeat_purchase', 'cooccurrence'], source_name) * 1000 + source_rank AS o FROM rec WHERE source_rank <= 50) GROUP BY 1, 2",
    "candidate_lists": "SELECT customer_id, string_agg(article_id, ' ' ORDER BY r, article_id) AS article_ids FROM (SELECT customer_id, article_id, min(source_rank) AS r FROM rec WHERE source_rank <= 10 GROUP BY 1, 2) GROUP BY 1",
    "source_attribution": "SELECT customer_id, " + ", ".join(f"count(*) FILTER (source_name = '{n}') AS {n}" for n in SOURCES) + " FROM rec GROUP BY 1",
    "customer_sample_hashed": "SELECT customer_id FROM (SELECT DISTINCT customer_id FROM cust) ORDER BY md5('42:' || customer_id), customer_id LIMIT 100",
    "apply_budget": "SELECT customer_id, article_id, " + ", ".join(f"count(*) FILTER (source_name = '{n}')::INT AS is_{n}, max(source_rank) FILTER (source_name = '{n}')::DOUBLE AS rank_{n}" for n in SOURCES) + ", count(*)::INT AS num_sources FROM rec WHERE source_rank <= CASE source_name WHEN 'recent_pop' THEN 50 WHEN 'cooccurrence' THEN 20 ELSE 500 END GROUP BY 1, 2",
    "budget_sweep": "SELECT fold, budget, round(map, 6) AS map, hits, candidates FROM sweep",
    "budget_choice": "SELECT min(budget) FILTER (round(m - b + 0.0002, 9) >= 0) AS chosen_budget, round(max(b), 6) AS best_map FROM (SELECT budget, avg(map) AS m, max(avg(map)) OVER () AS b FROM sweep GROUP BY 1)",
    "budget_efficiency": "SELECT s.fold, s.budget, s.hits - z.hits AS added_hits, s.candidates - z.candidates AS added_candidates, round((s.hits - z.hits) * 10000.0::DOUBLE / nullif(s.candidates - z.candidates, 0), 6) AS hits_per_10k FROM sweep s JOIN sweep z ON z.fold = s.fold AND z.budget = 0",
}.items()}

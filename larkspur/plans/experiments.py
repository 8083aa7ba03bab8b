"""Experiments over temporal folds: snapshots, rankers on expanding windows, arms against a base, frozen choices, the search study."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import candidates as c
from larkspur.operators import evaluation, features, folds, merge, metrics, rankers

Source = Callable[[DataFrame, DataFrame, str], DataFrame]


def default_sources(articles: DataFrame, pair_days: int = 90, min_pairs: int = 5) -> dict[str, Source]:
    """Name to (transactions, customers, cutoff) -> ranked candidates; any function of this shape is a source."""
    return {
        "recent_pop": lambda tx, who, cut: c.for_everyone(c.popular_recent(tx, cut, 7, 100), who),
        "repeat_purchase": c.repeat_purchase,
        "cooccurrence": lambda tx, who, cut: c.copurchase(tx, who, cut, pair_days, min_count=min_pairs),
        "content": lambda tx, who, cut: c.content(tx, who, articles, cut),
    }


def snapshot(tx: DataFrame, articles: DataFrame, sources: Mapping[str, Source], cutoff: str, days: int = 7, customers: int | None = None) -> DataFrame:
    """Labelled pair features of one cutoff: what is known on it, and what is bought in the ``days`` after it."""
    end = date.fromisoformat(cutoff)
    lab = folds.labels(tx, str(end + timedelta(days=1)), str(end + timedelta(days=days)))
    who = folds.first_customers(lab, customers) if customers else lab.select("customer_id").distinct()
    lab = lab.join(who, "customer_id", "left_semi")
    records = None
    for name, source in sources.items():
        part = c.as_records(source(tx, who, cutoff), name, cutoff)
        records = part if records is None else records.unionByName(part)
    pairs = features.labelled(features.pair_features(records, tx, articles, cutoff, list(sources)), lab)
    bucket = folds.history_buckets(who, folds.before(tx, cutoff)).select("customer_id", "bucket")
    return pairs.join(bucket, "customer_id", "left").withColumn("snapshot", F.lit(cutoff))


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table from its folder, built and written there first if it isn't."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_folds(snapshots: Sequence[DataFrame], columns: Sequence[str], spec: dict, first: int = 1, weights: tuple[str | None, str | None] = (None, None), negatives: tuple[int, int] | None = None) -> DataFrame:
    """(fold, customers, map, hit rate): fit on all snapshots before each, rank it, measure it. Later snapshots are never seen."""
    out = None
    for k in range(first, len(snapshots)):
        train = snapshots[0]
        for s in snapshots[1:k]:
            train = train.unionByName(s)
        if weights != (None, None):
            train = features.row_weights(train, *weights)
        if negatives:
            train = features.downsample(train, F.col("num_sources").cast("double"), *negatives, seed=17)
        ranked = rankers.slate(rankers.fit_from_spec(train, columns, spec).score(snapshots[k]))
        lab = snapshots[k].filter("label = 1").select("customer_id", "article_id")
        line = metrics.summarise(metrics.average_precision(lab, ranked.select("customer_id", "article_id", "rank"))).withColumn("fold", F.lit(k))
        out = line if out is None else out.unionByName(line)
    return out


def budget_sweep(snapshots: Sequence[DataFrame], columns: Sequence[str], sources: Sequence[str], variable: str, budgets: Sequence[int], spec: dict) -> DataFrame:
    """(budget, fold, map) for the smallest budget that is as good as the best to be chosen from."""
    out = None
    for b in budgets:
        capped = [merge.apply_budget(s, sources, variable, b) for s in snapshots]
        line = run_folds(capped, columns, spec).select(F.lit(b).alias("budget"), "fold", F.col("map_at_k").alias("map"))
        out = line if out is None else out.unionByName(line)
    return out


def compare_arms(base: DataFrame, arm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold results of two systems: how they compare, and whether the second is accepted."""
    both = base.select("fold", F.col("map_at_k").alias("base")).join(arm.select("fold", F.col("map_at_k").alias("arm")), "fold")
    return evaluation.compare_folds(both), merge.accepts(both)


def freeze(choices: Mapping[str, object]) -> dict[str, object]:
    """The chosen system as a document that names its own digest."""
    body = json.dumps(choices, sort_keys=True, default=str)
    return {"spec": json.loads(body), "frozen": True, "sha256": hashlib.sha256(body.encode()).hexdigest()}


def holdout_batches(frozen: Mapping[str, object], batches: Sequence[DataFrame], measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Unweighted mean of batch metrics; refused unless the system is frozen and unchanged."""
    if not frozen.get("frozen") or freeze(frozen["spec"])["sha256"] != frozen.get("sha256"):
        raise ValueError("the system must be frozen before the holdout is looked at")
    out = None
    for b in batches:
        line = measure(b)
        out = line if out is None else out.unionByName(line)
    return out.agg(*[F.avg(x).alias(x) for x, kind in out.dtypes if kind == "double"])


def search_study(pairs: DataFrame, columns: Sequence[str], base: str, least_gain: float = 0.01, held: int = 4, **options) -> DataFrame:
    """(queries, base_ndcg, learned_ndcg, kept): trees learned on some queries against the hybrid score on the others.

    pairs: (query_id, article_id, relevance, features, a score named ``base``). One query in ``held``, by a hash, is for measuring only. A pair of
    relevance 3 or more is a positive. The learned order is kept if it gains ``least_gain``.
    """
    kept_out = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(held)) == 0
    rows = pairs.withColumn("label", (F.col("relevance") >= 3).cast("int"))
    test = rankers.fit_trees(rows.filter(~kept_out), columns, **options).score(rows.filter(kept_out))
    arms = None
    for name, score in (("base", base), ("learned", "ranker_score")):
        ranked = folds.top_rank(test.select("query_id", "article_id", "relevance", score), ["query_id"], [F.round(score, 9).desc(), "article_id"], None)
        line = metrics.ndcg(ranked).withColumnRenamed("ndcg", name)
        arms = line if arms is None else arms.join(line, "query_id")
    out = arms.agg(F.count(F.lit(1)).alias("queries"), F.avg("base").alias("base_ndcg"), F.avg("learned").alias("learned_ndcg"))
    return out.withColumn("kept", F.col("learned_ndcg") >= F.col("base_ndcg") + least_gain)

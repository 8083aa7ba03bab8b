"""Candidate sources. Each gives (customer_id, article_id, source_rank, source_score) or a global list; all rank by
score rounded to nine decimals, then identifier. The long table of ``as_records`` is what sources, merging and
features exchange.

Scale: sources filter by date before anything else; customers are applied before ranking; per-customer top-k is a
window whose limit Spark pushes below the shuffle. Baskets are joined with themselves only inside the lookback.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import decay, ranked9, within_days
from larkspur.operators.folds import before, top_rank
from larkspur.sources.relations import CATEGORIES


#: Classes of articles with the same tokens up to which a catalogue is sent to all tasks: 50 MB, and 8 bytes for each article.
CATALOGUE = 500_000


def as_records(ranked: DataFrame, source: str, cutoff: str, model: str = "v1") -> DataFrame:
    return ranked.select(
        "customer_id",
        "article_id",
        F.lit(source).alias("source_name"),
        F.col("source_rank").cast("int").alias("source_rank"),
        F.col("source_score").cast("double").alias("source_score"),
        F.lit(model).alias("model_version"),
        F.lit(cutoff).cast("date").alias("feature_cutoff"),
    )


def _top(counted: DataFrame, k: int) -> DataFrame:
    """The first k as (article_id, score, rank); a global list has k lines, so ranking it takes one small task."""
    first = counted.orderBy(ranked9(F.col("score")).desc(), "article_id").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(ranked9(F.col("score")).desc(), "article_id")).cast("long"))


def popular_all_history(tx: DataFrame, cutoff: str, k: int = 500) -> DataFrame:
    return _top(before(tx, cutoff).groupBy("article_id").agg(F.count(F.lit(1)).cast("double").alias("score")), k)


def popular_recent(tx: DataFrame, cutoff: str, days: int = 7, k: int = 500) -> DataFrame:
    return _top(tx.filter(within_days(F.col("transaction_date"), cutoff, days)).groupBy("article_id").agg(F.count(F.lit(1)).cast("double").alias("score")), k)


def popular_decayed(tx: DataFrame, cutoff: str, half_life: float = 14.0, k: int = 500) -> DataFrame:
    return _top(before(tx, cutoff).groupBy("article_id").agg(F.sum(decay(F.col("transaction_date"), cutoff, half_life)).alias("score")), k)


def for_everyone(top: DataFrame, customers: DataFrame) -> DataFrame:
    """A global list for each customer. The list is broadcast; it has k lines."""
    listed = F.broadcast(top.select("article_id", F.col("rank").alias("source_rank"), F.col("score").alias("source_score")))
    return customers.select("customer_id").distinct().crossJoin(listed)


def repeat_purchase(tx: DataFrame, customers: DataFrame, cutoff: str, half_life: float = 30.0, k: int = 500) -> DataFrame:
    mine = before(tx, cutoff).join(customers.select("customer_id").distinct(), "customer_id", "left_semi")
    scored = mine.groupBy("customer_id", "article_id").agg(F.sum(decay(F.col("transaction_date"), cutoff, half_life)).alias("source_score"))
    return top_rank(scored, ["customer_id"], [ranked9(F.col("source_score")).desc(), "article_id"], k, "source_rank")


def copurchase_pairs(tx: DataFrame, cutoff: str, days: int = 90, min_count: int = 5) -> DataFrame:
    """(a, b, n, pmi) of articles in one basket (customer and day); rows, not baskets, are the universe of the measure.

    Equal lines of a basket are counted first and multiplied, so a line bought many times doesn't multiply the join.
    """
    window = tx.filter(within_days(F.col("transaction_date"), cutoff, days))
    lines = window.groupBy("customer_id", "transaction_date", "article_id").agg(F.count(F.lit(1)).alias("m"))
    a = lines.select("customer_id", "transaction_date", F.col("article_id").alias("a"), F.col("m").alias("ma"))
    b = lines.select("customer_id", "transaction_date", F.col("article_id").alias("b"), F.col("m").alias("mb"))
    pairs = a.join(b, ["customer_id", "transaction_date"]).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("ma") * F.col("mb")).alias("n")).filter(F.col("n") >= min_count)
    freq = lines.groupBy("article_id").agg(F.sum("m").alias("f"))
    total = F.broadcast(lines.agg(F.sum("m").cast("double").alias("total")))
    return (
        pairs.crossJoin(total)
        .join(freq.select(F.col("article_id").alias("a"), F.col("f").alias("fa")), "a")
        .join(freq.select(F.col("article_id").alias("b"), F.col("f").alias("fb")), "b")
        .select("a", "b", "n", F.log(F.col("n") * F.col("total") / (F.col("fa").cast("double") * F.col("fb"))).alias("pmi"))
    )


def neighbours(pairs: DataFrame, k: int = 50) -> DataFrame:
    """(seed, article_id, pmi, rank): both directions, the k best of each seed."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("seed"), F.col("b").alias("article_id")), F.struct(F.col("b").alias("seed"), F.col("a").alias("article_id")))).alias("e"), "pmi")
    return top_rank(both.select("e.*", "pmi"), ["seed"], [ranked9(F.col("pmi")).desc(), "article_id"], k)


def copurchase(tx: DataFrame, customers: DataFrame, cutoff: str, days: int = 90, per_seed: int = 50, k: int = 500, min_count: int = 5) -> DataFrame:
    near = neighbours(copurchase_pairs(tx, cutoff, days, min_count), per_seed)
    owned = before(tx, cutoff).join(customers.select("customer_id").distinct(), "customer_id", "left_semi").select("customer_id", "article_id").distinct()
    seeds = owned.select("customer_id", F.col("article_id").alias("seed"))
    scored = seeds.join(near.select("seed", "article_id", "pmi"), "seed").groupBy("customer_id", "article_id").agg(F.sum("pmi").alias("source_score"))
    return top_rank(scored.join(owned, ["customer_id", "article_id"], "left_anti"), ["customer_id"], [ranked9(F.col("source_score")).desc(), "article_id"], k, "source_rank")


# --------------------------------------------------------------------------- content


def token_list() -> Column:
    """The tokens of an article's filled categories."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.trim(F.coalesce(F.col(c), F.lit(""))).alias("value")) for c in CATEGORIES])
    return F.transform(F.filter(pairs, lambda p: p["value"] != ""), lambda p: F.concat_ws("=", p["field"], p["value"]))


def article_tokens(articles: DataFrame) -> DataFrame:
    """(article_id, token, weight): a unit vector over the filled categories."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.trim(F.coalesce(F.col(c), F.lit(""))).alias("value")) for c in CATEGORIES])
    filled = F.filter(pairs, lambda p: p["value"] != "")
    return articles.select("article_id", F.explode(filled).alias("t"), (1.0 / F.sqrt(F.size(filled))).alias("weight")).select("article_id", F.concat_ws("=", "t.field", "t.value").alias("token"), "weight")


def content_profiles(tx: DataFrame, customers: DataFrame, tokens: DataFrame, cutoff: str, half_life: float = 90.0) -> DataFrame:
    """(customer_id, token, weight): unit vectors of decayed purchases. Customers without any have no lines.

    Tokens are several lines of long strings for an article, which Spark's estimate from the files doesn't know, so they are never broadcast.
    """
    mine = before(tx, cutoff).join(customers.select("customer_id").distinct(), "customer_id", "left_semi")
    bought = mine.groupBy("customer_id", "article_id").agg(F.sum(decay(F.col("transaction_date"), cutoff, half_life)).alias("w"))
    raw = bought.join(tokens.hint("merge"), "article_id").groupBy("customer_id", "token").agg(F.sum(F.col("w") * F.col("weight")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("customer_id")))
    return raw.withColumn("weight", F.col("raw") / norm).select("customer_id", "token", "weight")


def content(tx: DataFrame, customers: DataFrame, articles: DataFrame, cutoff: str, half_life: float = 90.0, k: int = 500, oversample: int = 100) -> DataFrame:
    """Cosine of profile and article. The k + oversample best are ranked, then owned ones go, then k stay.

    Articles with the same tokens have the same score, so classes of them are scored. Up to CATALOGUE classes, which are counted first, are sent to all
    tasks as token numbers and scored in blocks of customers; pairs are never shuffled. More are joined by token.
    """
    if _classes(articles, k + oversample).limit(CATALOGUE + 1).count() <= CATALOGUE:
        return _content_blocks(tx, customers, articles, cutoff, half_life, k, oversample)
    tokens = article_tokens(articles)
    profile = content_profiles(tx, customers, tokens, cutoff, half_life)
    scored = profile.withColumnRenamed("weight", "u").join(tokens.hint("merge"), "token").groupBy("customer_id", "article_id").agg(F.sum(F.col("u") * F.col("weight")).alias("source_score"))
    order = [ranked9(F.col("source_score")).desc(), "article_id"]
    best = top_rank(scored, ["customer_id"], order, k + oversample, "_r").drop("_r")
    owned = before(tx, cutoff).select("customer_id", "article_id").distinct()
    return top_rank(best.join(owned, ["customer_id", "article_id"], "left_anti"), ["customer_id"], order, k, "source_rank")


def _classes(articles: DataFrame, most: int) -> DataFrame:
    """(t, ids): hashes of the tokens that a class of articles has, and its ``most`` least articles; no list of that length can hold others."""
    tokens = F.transform(F.array(*[F.struct(F.lit(c).alias("field"), F.trim(F.coalesce(F.col(c), F.lit(""))).alias("value")) for c in CATEGORIES]), lambda p: F.when(p["value"] != "", F.xxhash64(F.concat_ws("=", p["field"], p["value"]))))
    numbered = articles.select("article_id", F.array_compact(tokens).alias("t")).filter(F.size("t") > 0)
    return top_rank(numbered, ["t"], ["article_id"], most, "_r").groupBy("t").agg(F.array_sort(F.collect_list("article_id")).alias("ids"))


def best_of_classes(scores: np.ndarray, first: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best articles of a row of class scores, rounded to nine decimals, and their classes; of equal ones the least. Class c has
    ids[first[c] : first[c + 1]]; scores of -inf are left out."""
    open_ = np.flatnonzero(scores > -np.inf)
    q = np.floor(scores[open_] * 1e9 + 0.5)
    if len(q) > k:
        least = np.partition(q, len(q) - k)[len(q) - k]
        open_, q = open_[q >= least], q[q >= least]
    order = np.argsort(-q, kind="stable")
    open_, q = open_[order], q[order]
    n = first[open_ + 1] - first[open_]
    if n.sum() > k:
        enough = q >= q[np.searchsorted(np.cumsum(n), k)]
        open_, q, n = open_[enough], q[enough], n[enough]
    at = np.repeat(first[open_] - np.cumsum(n) + n, n) + np.arange(n.sum())
    order = np.lexsort((ids[at], -np.repeat(q, n)))[:k]
    return ids[at[order]], np.repeat(open_, n)[order]


def _content_blocks(tx: DataFrame, customers: DataFrame, articles: DataFrame, cutoff: str, half_life: float, k: int, oversample: int) -> DataFrame:
    from larkspur.operators.vectors import BLOCK

    tokens = article_tokens(articles)
    table = _classes(articles, k + oversample).toArrow()
    listed, members = table.column("t").combine_chunks(), table.column("ids").combine_chunks()
    ids, first = members.flatten().to_numpy(), members.offsets.to_numpy().astype(np.int64)
    first = first - first[0] if len(first) else np.zeros(1, np.int64)
    vocabulary, code = np.unique(listed.flatten().to_numpy(), return_inverse=True)
    size = np.diff(listed.offsets.to_numpy()) if len(listed) else np.zeros(0, np.int64)
    row, place = np.repeat(np.arange(len(size)), size), np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    # A line per class of its tokens' numbers; lines are filled up with a token that no profile has.
    codes, weights = np.full((len(size), len(CATEGORIES)), len(vocabulary), np.int32), 1.0 / np.sqrt(np.maximum(size, 1))
    codes[row, place] = code
    sent = tx.sparkSession.sparkContext.broadcast((ids, first, vocabulary, codes, weights))
    cells = content_profiles(tx, customers, tokens, cutoff, half_life).select("customer_id", F.struct(F.xxhash64("token").alias("t"), "weight").alias("c"), F.lit(None).cast("long").alias("own"))
    mine = before(tx, cutoff).join(customers.select("customer_id").distinct(), "customer_id", "left_semi").select("customer_id", "article_id").distinct()
    both = cells.unionByName(mine.select("customer_id", F.lit(None).cast(cells.schema["c"].dataType).alias("c"), F.col("article_id").alias("own")))
    profiles = both.groupBy("customer_id").agg(F.collect_list("c.t").alias("t"), F.collect_list("c.weight").alias("u"), F.collect_list("own").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, vocabulary, codes, weights = sent.value
        rows = max(1, BLOCK // max(len(codes), len(vocabulary), 1))
        for batch in batches:
            for lo in range(0, len(batch), rows):
                part = batch.slice(lo, rows)
                u = np.zeros((len(part), len(vocabulary) + 1))
                for i, (t, w) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    u[i, np.searchsorted(vocabulary, np.array(t, np.int64))] = w
                scores = np.zeros((len(part), len(codes)))
                for f in range(codes.shape[1]):
                    scores += u[:, codes[:, f]] * weights
                scores[scores <= 0] = -np.inf
                found, valued = [], []
                for own, line in zip(part.column(3).to_pylist(), scores, strict=True):
                    best, of = best_of_classes(line, first, ids, k + oversample)
                    new = np.flatnonzero(~np.isin(best, own))[:k]
                    found.append(best[new])
                    valued.append(line[of[new]])
                n = [len(b) for b in found]
                if sum(n):
                    out = [part.column(0).take(pa.array(np.repeat(np.arange(len(part)), n))), pa.array(np.concatenate(found)), pa.array(np.concatenate(valued)), pa.array(np.concatenate([np.arange(1, m + 1) for m in n]))]
                    yield pa.RecordBatch.from_arrays(out, names=["customer_id", "article_id", "source_score", "source_rank"])

    kind = profiles.schema["customer_id"].dataType.simpleString()
    return profiles.mapInArrow(run, f"customer_id {kind}, article_id long, source_score double, source_rank long")


# --------------------------------------------------------------------------- factors


def als(tx: DataFrame, customers: DataFrame, cutoff: str, rank: int = 64, reg: float = 0.01, iterations: int = 15, alpha: float = 40.0, k: int = 500, seed: int = 42) -> DataFrame:
    """Implicit-feedback factors of purchase counts. Identifiers must fit an int; cold customers get nothing.

    Factors are checkpointed at each iteration, so that its shuffle can be dropped. Blocks are a multiple of the cores, about 10 or one for each core, so that
    none waits for a last few; more would copy factors to more places. Start factors are drawn by block, so they go by the number of cores. Customers are scored against slabs of articles, without a shuffle of pairs.
    """
    from pyspark.ml.recommendation import ALS

    from larkspur.operators.vectors import rank_slabs
    from larkspur.sources.session import shared_folder

    sc = tx.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(tx.sparkSession))
    counts = before(tx, cutoff).groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).cast("float").alias("n"))
    blocks = sc.defaultParallelism * max(1, 10 // sc.defaultParallelism)
    model = ALS(numUserBlocks=blocks, numItemBlocks=blocks, userCol="customer_id", itemCol="article_id", ratingCol="n", rank=rank, regParam=reg, maxIter=iterations, alpha=alpha, implicitPrefs=True, seed=seed, coldStartStrategy="drop", checkpointInterval=1).fit(counts)
    factors = lambda table, name: table.select(F.col("id").alias(name), F.col("features").alias("embedding"))
    users = factors(model.userFactors, "customer_id").join(customers.select("customer_id").distinct(), "customer_id", "left_semi")
    return rank_slabs(users, "customer_id", factors(model.itemFactors, "article_id"), k)


def source_attribution(records: DataFrame, sources: list[str]) -> DataFrame:
    """Candidates per customer and source, 0 where a source gave none."""
    return records.groupBy("customer_id").pivot("source_name", sources).agg(F.count_distinct("article_id")).na.fill(0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)

"""Features of (customer, article) pairs, labels, weights, samples and normalisation. All in expressions and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import days_before, within_days
from larkspur.operators.candidates import dot
from larkspur.operators.folds import before, seeded
from larkspur.sources.relations import CATEGORIES

PER_SOURCE = 500
#: Columns whose spread is compressed before they are standardised.
LOGGED = (  # fixed values
    "times_bought_item", "times_bought_product_type", "times_bought_garment_group", "item_purchases_7d", "item_purchases_30d", "item_unique_buyers_30d", "days_since_bought_item", "days_since_bought_product_type", "days_since_bought_garment_group",
)


def feature_columns(sources: Sequence[str]) -> list[str]:
    own = [f"{p}_{s}" for s in sources for p in ("is", "rank", "rank_pct", "score")]
    history = [f"affinity_{c}" for c in CATEGORIES] + ["days_since_bought_item", "days_since_bought_product_type", "days_since_bought_garment_group", "times_bought_item", "times_bought_product_type", "times_bought_garment_group"]
    return [*own, "num_sources", *history, "item_purchases_7d", "item_purchases_30d", "item_purchase_growth", "item_unique_buyers_30d"]


def item_stats(tx: DataFrame, cutoff: str) -> DataFrame:
    """Purchases in 7 and 30 days, buyers in 30, and growth: 0 if all of 30 days fell in the last 7."""
    d = F.col("transaction_date")
    month = tx.filter(within_days(d, cutoff, 30))
    s = month.groupBy("article_id").agg(F.count_if(within_days(d, cutoff, 7)).alias("item_purchases_7d"), F.count(F.lit(1)).alias("item_purchases_30d"), F.count_distinct("customer_id").alias("item_unique_buyers_30d"))
    growth = F.when(F.col("item_purchases_30d") > F.col("item_purchases_7d"), F.col("item_purchases_7d") / F.greatest(F.col("item_purchases_30d") - F.col("item_purchases_7d"), F.lit(1))).otherwise(0.0)
    return s.withColumn("item_purchase_growth", growth)


def affinities(tx: DataFrame, articles: DataFrame, cutoff: str) -> DataFrame:
    """(customer_id, field, value, share): of the purchases with a value in the field, the share with this one."""
    history = before(tx, cutoff).groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n")).join(articles, "article_id", "left")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in CATEGORIES]))
    long = history.select("customer_id", "n", fields.alias("f")).select("customer_id", "n", "f.*").filter("value IS NOT NULL AND value <> ''")
    counted = long.groupBy("customer_id", "field", "value").agg(F.sum("n").alias("n"))
    return counted.select("customer_id", "field", "value", (F.col("n") / F.sum("n").over(Window.partitionBy("customer_id", "field"))).alias("share"))


#: What recency and frequency are counted over, and the column that tells it.
HISTORY_KEYS = {"item": "article_id", "product_type": "product_type_name", "garment_group": "garment_group_name"}


def recency_frequency(tx: DataFrame, articles: DataFrame, cutoff: str) -> dict[str, DataFrame]:
    """Days since, and number of, purchases of an article, a product type, a garment group, per customer."""
    history = before(tx, cutoff).join(articles.select("article_id", "product_type_name", "garment_group_name"), "article_id", "left")
    return {
        key: history.filter(F.col(col).isNotNull())
        .groupBy("customer_id", col)
        .agg(F.min(days_before(F.col("transaction_date"), cutoff)).alias(f"days_since_bought_{key}"), F.count(F.lit(1)).alias(f"times_bought_{key}"))
        for key, col in HISTORY_KEYS.items()
    }


def history_maps(tx: DataFrame, articles: DataFrame, cutoff: str) -> DataFrame:
    """A line per customer with history: for the article and each category a map of value to purchases and days since the last, and the purchases
    with a filled value. All features of a customer's history then take one join on the customer."""
    fields = ("article_id", *CATEGORIES)
    bought = before(tx, cutoff).groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"), F.min(days_before(F.col("transaction_date"), cutoff)).alias("days"))
    # dealt by customer before the cells are written out: both groupings below then need no shuffle of their own
    rows = bought.join(articles.select("article_id", *CATEGORIES), "article_id", "left").repartition("customer_id")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).cast("string").alias("value")) for i, c in enumerate(fields)])).alias("c")
    counted = rows.select("customer_id", "n", "days", cells).filter("c.value IS NOT NULL").groupBy("customer_id", "c.field", "c.value").agg(F.sum("n").alias("n"), F.min("days").alias("days"))
    of = lambda i, x: F.when(F.col("field") == i, x)
    entry = F.struct("value", F.struct("n", "days"))
    maps = [F.map_from_entries(F.collect_list(of(i, entry))).alias(f"_map_{c}") for i, c in enumerate(fields)]
    sums = [F.sum(of(i, F.when(F.col("value") != "", F.col("n")))).alias(f"_sum_{c}") for i, c in enumerate(fields)]
    return counted.groupBy("customer_id").agg(*maps, *sums, F.sum(of(0, F.col("n"))).alias("_total"))


def pair_features(records: DataFrame, tx: DataFrame, articles: DataFrame, cutoff: str, sources: Sequence[str], per_source: int = PER_SOURCE) -> DataFrame:
    """A line per pair with the columns of ``feature_columns``.

    Null: what a source that didn't name the pair would say, and history features of customers without history or articles
    without metadata. With history but no match: affinity 0, days -1, counts 0. Item counts default to 0.
    """
    pivot = records.groupBy("customer_id", "article_id").pivot("source_name", list(sources)).agg(F.max("source_rank").alias("rank"), F.max("source_score").alias("score"))
    out = pivot.select(
        "customer_id",
        "article_id",
        *[c for s in sources for c in (
            F.col(f"{s}_rank").isNotNull().cast("int").alias(f"is_{s}"),
            F.col(f"{s}_rank").alias(f"rank_{s}"),
            (F.col(f"{s}_rank") / F.lit(float(per_source))).alias(f"rank_pct_{s}"),
            F.col(f"{s}_score").alias(f"score_{s}"),
        )],
    )
    out = out.withColumn("num_sources", sum((F.col(f"is_{s}") for s in sources[1:]), F.col(f"is_{sources[0]}")))
    meta = articles.select("article_id", *CATEGORIES).withColumn("_meta", F.lit(True))
    out = out.join(meta, "article_id", "left")
    mine = tx.join(records.select("customer_id").distinct(), "customer_id", "left_semi")
    out = out.join(history_maps(mine, articles, cutoff), "customer_id", "left")
    known = F.col("_total").isNotNull() & F.col("_meta").isNotNull()
    seen = {c: F.try_element_at(F.col(f"_map_{c}"), F.col(c).cast("string")) for c in ("article_id", *CATEGORIES)}
    share = {c: F.when(F.col(c) != "", F.coalesce(seen[c]["n"] / F.col(f"_sum_{c}"), F.lit(0.0))).otherwise(0.0) for c in CATEGORIES}
    out = out.select(
        *out.columns,
        *[F.when(known, share[c]).alias(f"affinity_{c}") for c in CATEGORIES],
        *[F.when(known, F.coalesce(seen[c]["days"], F.lit(-1))).alias(f"days_since_bought_{key}") for key, c in HISTORY_KEYS.items()],
        *[F.when(known, F.coalesce(seen[c]["n"], F.lit(0))).alias(f"times_bought_{key}") for key, c in HISTORY_KEYS.items()],
    )
    stats = item_stats(tx, cutoff)
    out = out.join(stats, "article_id", "left").na.fill(0, ["item_purchases_7d", "item_purchases_30d", "item_unique_buyers_30d"]).na.fill(0.0, ["item_purchase_growth"])
    return out.select("customer_id", "article_id", *feature_columns(sources))


def labelled(features: DataFrame, label_rows: DataFrame) -> DataFrame:
    marked = label_rows.select("customer_id", "article_id").distinct().withColumn("_l", F.lit(1))
    return features.join(marked, ["customer_id", "article_id"], "left").withColumn("label", F.coalesce("_l", F.lit(0))).drop("_l")


def groups(features: DataFrame) -> DataFrame:
    return features.groupBy("customer_id").agg(F.count(F.lit(1)).alias("group_size"))


def crosses(features: DataFrame, factor: str = "als", dense: str = "two_tower", repeat: str = "repeat_purchase") -> DataFrame:
    """Six crosses of source signals. Nulls read as score 0, a year since the purchase, rank 500."""
    z = lambda c, v: F.coalesce(F.col(c).cast("double"), F.lit(float(v)))
    f, d = z(f"score_{factor}", 0), z(f"score_{dense}", 0)
    fr, dr = z(f"rank_{factor}", 500), z(f"rank_{dense}", 500)
    since = F.greatest(z("days_since_bought_item", 365), F.lit(0.0))
    return features.withColumns({
        "cross_als_tt": f * d,
        "cross_tt_sources": d * F.col("num_sources"),
        "cross_sources_logpop": F.col("num_sources") * F.log1p(z("item_purchases_30d", 0)),
        "cross_repeat_recency": z(f"score_{repeat}", 0) / (since + 1.0),
        "als_rank_minus_tt_rank": fr - dr,
        "min_als_tt_rank": F.least(fr, dr),
    })


def popularity_weight(label: Column, p30: Column) -> Column:
    """Positives of popular articles weigh less; clipped to 0.25 to 4."""
    return F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.when(label == 1, 1.0 / F.sqrt(F.greatest(p30.cast("double"), F.lit(1.0)))).otherwise(1.0)))


def group_weight(size: Column) -> Column:
    return 1.0 / F.sqrt(F.greatest(size.cast("double"), F.lit(1.0)))


#: The middle of each history bucket.
MIDPOINTS = {"0": 0.0, "1-2": 1.5, "3-5": 4.0, "6-10": 8.0, "11-20": 15.5, "20+": 25.0}


def bucket_weight(bucket: Column) -> Column:
    middle = F.create_map(*[x for k, v in MIDPOINTS.items() for x in (F.lit(k), F.lit(v))])
    return 1.0 / F.sqrt(1.0 + F.coalesce(F.try_element_at(middle, bucket), F.lit(8.0)))


def row_weights(features: DataFrame, label_scheme: str | None = None, group_scheme: str | None = None) -> DataFrame:
    """The product of a weight by label (``inv_sqrt_popularity``) and one by customer (``inv_sqrt_group_size``, ``inv_sqrt_history``)."""
    by_label = {None: F.lit(1.0), "inv_sqrt_popularity": popularity_weight(F.col("label"), F.col("item_purchases_30d"))}
    size = F.count(F.lit(1)).over(Window.partitionBy("customer_id"))
    by_group = {None: F.lit(1.0), "unweighted": F.lit(1.0), "inv_sqrt_group_size": group_weight(size)}
    if group_scheme == "inv_sqrt_history":
        by_group[group_scheme] = bucket_weight(F.col("bucket"))
    if label_scheme not in by_label or group_scheme not in by_group:
        raise ValueError(f"unknown weighting {label_scheme}, {group_scheme}")
    return features.withColumn("weight", by_label[label_scheme] * by_group[group_scheme])


def downsample(features: DataFrame, hardness: Column, hard: int, random: int, seed: int) -> DataFrame:
    """All positives, the hardest negatives of each customer, and some of the others by a seeded hash."""
    f = features.withColumn("_hard", hardness)
    w = Window.partitionBy("customer_id", "label")
    f = f.withColumn("_h", F.row_number().over(w.orderBy(F.col("_hard").desc_nulls_last(), "article_id")))
    rest = Window.partitionBy("customer_id", "label", F.col("_h") > hard)
    f = f.withColumn("_r", F.row_number().over(rest.orderBy(seeded(seed, "customer_id", "article_id"), "article_id")))
    return f.filter((F.col("label") == 1) | (F.col("_h") <= hard) | (F.col("_r") <= random)).drop("_hard", "_h", "_r")


def pairwise_rows(features: DataFrame, score_columns: Sequence[str], per_positive: int = 10, hard_share: float = 0.5, seed: int = 42) -> DataFrame:
    """(customer_id, positive, negative): for each positive some hard negatives (by best source score) and random ones."""
    n_hard = int(per_positive * hard_share)
    best = F.greatest(*[F.coalesce(F.col(c), F.lit(float("-inf"))) for c in score_columns]) if len(score_columns) > 1 else F.coalesce(F.col(score_columns[0]), F.lit(float("-inf")))
    neg = features.filter("label = 0").withColumn("_b", best)
    ranked = neg.withColumn("_h", F.row_number().over(Window.partitionBy("customer_id").orderBy(F.col("_b").desc(), "article_id"))).select("customer_id", F.col("article_id").alias("negative"), "_h")
    pos = features.filter("label = 1").select("customer_id", F.col("article_id").alias("positive"))
    keep = ranked.filter((F.col("_h") <= 3 * n_hard) | (F.pmod(F.xxhash64(F.lit(seed), "customer_id", "negative"), F.lit(8)) == 0))
    joined = pos.join(keep, "customer_id").withColumn("_u", F.xxhash64(F.lit(seed), "customer_id", "positive", "negative"))
    is_hard = F.col("_h") <= 3 * n_hard
    place = F.row_number().over(Window.partitionBy("customer_id", "positive", is_hard).orderBy("_u"))
    return joined.withColumn("_p", place).filter(F.col("_p") <= F.when(is_hard, n_hard).otherwise(per_positive - n_hard)).select("customer_id", "positive", "negative")


def fit_normaliser(features: DataFrame, columns: Sequence[str], skip: Sequence[str] = ("num_sources",)) -> DataFrame:
    """(feature, mean, std) after nulls become 0 and long-tailed columns are logged; a spread under 1e-6 counts as 1."""
    cells = features.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _cleaned(c).alias("v")) for c in columns if c not in skip])).alias("x")).select("x.*")
    s = cells.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return s.select("feature", "mean", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")).alias("std"))


def _cleaned(c: str) -> Column:
    v = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.log1p(F.greatest(v, F.lit(0.0))) if c in LOGGED else v


def normalise(features: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return features.withColumns({c: (_cleaned(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def user_numeric(tx: DataFrame, customers: DataFrame, cutoff: str) -> DataFrame:
    """Per customer: purchases, distinct articles, mean and spread of price, share of channel 2, active span, days since the last."""
    h = before(tx, cutoff).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("article_id").alias("n_articles"), F.avg("price").alias("price_mean"), F.stddev_pop("price").alias("price_std"),
        F.avg((F.col("sales_channel_id") == 2).cast("double")).alias("channel2_share"), F.datediff(F.max("transaction_date"), F.min("transaction_date")).alias("span_days"),
        days_before(F.max("transaction_date"), cutoff).alias("days_since_last"),
    )
    c = customers.select("customer_id").distinct().join(h, "customer_id", "left")
    log = lambda n: F.log1p(F.greatest(F.coalesce(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(n)
    return c.select("customer_id", log("n"), log("n_articles"), log("price_mean"), log("price_std"), F.coalesce("channel2_share", F.lit(0.0)).alias("channel2_share"), log("span_days"), log("days_since_last"))


def latest_history(tx: DataFrame, cutoff: str, n: int = 50) -> DataFrame:
    """The last n purchases of each customer, newest first, equal days by article."""
    w = Window.partitionBy("customer_id").orderBy(F.col("transaction_date").desc(), "article_id", F.col("price"))
    return before(tx, cutoff).withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= n)


def vocabulary(rows: DataFrame, fields: Sequence[str], first: int = 1) -> DataFrame:
    """(field, value, index): distinct filled values in order, numbered per field; 0 is left for unknown."""
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("value")) for f in fields])).alias("c")).select("c.*")
    values = cells.filter("value <> ''").distinct()
    return values.withColumn("index", (F.row_number().over(Window.partitionBy("field").orderBy("value")) - 1 + first).cast("long"))


def dense_scores(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Dot product of each pair's vectors."""
    j = pairs.join(users.select("customer_id", F.col("embedding").alias("_u")), "customer_id").join(items.select("article_id", F.col("embedding").alias("_v")), "article_id")
    return j.withColumn("dense_score", dot(F.col("_u"), F.col("_v"))).drop("_u", "_v")


def group_ranks(scored: DataFrame, score: str) -> DataFrame:
    """Each row's place in its customer's list, and the place as a share of the list."""
    w = Window.partitionBy("customer_id")
    place = F.row_number().over(w.orderBy(F.round(score, 9).desc(), "article_id")).cast("long")
    return scored.withColumn("group_rank", place).withColumn("group_pct", F.col("group_rank") / F.count(F.lit(1)).over(w))

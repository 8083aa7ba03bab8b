"""Data audit: sizes, quality, domains, distributions and coldness of the three relations.

Every audit is one plan. Quantiles are exact and interpolate. Global ranks are taken after aggregation and only as far as needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import blank, null_label

ROW = ["transaction_date", "customer_id", "article_id", "price", "sales_channel_id"]


def N() -> Column:
    return F.count(F.lit(1))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def overview(tables: Mapping[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """A line per relation: rows, distinct keys, distinct second keys (0 where there is none)."""
    out = None
    for name, (df, key, second) in tables.items():
        line = df.agg(N().alias("n_rows"), F.count_distinct(key).alias("n_keys"), (F.count_distinct(second) if second else F.lit(0).cast("long")).alias("n_second_keys")).withColumn("relation", F.lit(name))
        out = line if out is None else out.unionByName(line)
    return out


def transaction_quality(tx: DataFrame) -> DataFrame:
    length = lambda c, f: f(F.length(F.col(c).cast("string")))
    return tx.agg(
        F.min("transaction_date").alias("first_day"), F.max("transaction_date").alias("last_day"), F.count_if(F.col("transaction_date").isNull()).alias("bad_dates"),
        F.count_if(blank(F.col("customer_id").cast("string"))).alias("blank_customers"), F.count_if(blank(F.col("article_id").cast("string"))).alias("blank_articles"),
        F.count_if(F.col("price").isNull()).alias("bad_prices"), F.count_if(F.col("price") <= 0).alias("free_prices"), F.count_if(F.col("sales_channel_id").isNull()).alias("bad_channels"),
        length("customer_id", F.min).alias("min_customer_length"), length("customer_id", F.max).alias("max_customer_length"), length("article_id", F.min).alias("min_article_length"), length("article_id", F.max).alias("max_article_length"),
    )


def key_quality(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    out = None
    for name, (df, key) in tables.items():
        line = df.agg(N().alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count_if(blank(F.col(key).cast("string"))).alias("blank_keys")).withColumn("relation", F.lit(name))
        out = line if out is None else out.unionByName(line)
    return out


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A line per column: how many are null or blank. One scan; the counts are turned into lines afterwards."""
    counts = df.agg(N().alias("_n"), *[F.count_if(blank(F.col(c).cast("string"))).alias(c) for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns])).alias("c")
    return counts.select("_n", cells).select("c.column_name", "c.n_missing", F.coalesce(r6(100.0 * F.col("c.n_missing") / F.nullif(F.col("_n"), F.lit(0))), F.lit(0.0)).alias("percent"))


def spread(df: DataFrame, column: str, quantiles: Mapping[str, float]) -> list[Column]:
    """Aggregates of a numeric column: least, greatest, mean and named quantiles, all from one collection of its values."""
    all_ = F.expr(f"percentile({column}, array({', '.join(f'{q}D' for q in quantiles.values())}))")
    out = [F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"), r6(F.avg(column)).alias(f"mean_{column}")]
    return out + [r6(all_[i]).alias(f"{name}_{column}") for i, name in enumerate(quantiles)]


def profile_quality(customers: DataFrame, column: str = "acctbal") -> DataFrame:
    text = customers.select(F.col(column).cast("string").alias("_t"), F.expr(f"try_cast({column} AS double)").alias(column), "fashion_news_frequency")
    return text.agg(
        F.count_if(F.col("_t").isNotNull() & F.col(column).isNull()).alias("bad_values"), *spread(text, column, {"p25": 0.25, "median": 0.5, "p75": 0.75}),
        F.count_if(F.col(column) < 0).alias("n_negative"), F.count_if(F.col(column) > 9000).alias("n_large"), F.count_distinct("fashion_news_frequency").alias("n_places"),
    )


def domains(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Values of each field with their number and share of the field."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), null_label(F.col(f).cast("string")).alias("value")) for f in fields])).alias("c")
    n = df.select(cells).groupBy("c.field", "c.value").agg(N().alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("field")), 4))


def shape(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns], F.count_if(blank(F.col(text))).alias(f"blank_{text}"))


def key_coverage(tx: DataFrame, dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """For each key: how many distinct ones are used, and how many of them the dimension lacks."""
    out = None
    for key, dim in dimensions.items():
        used = tx.select(key).distinct()
        line = used.join(dim.select(key).distinct().withColumn("_in", F.lit(1)), key, "left").agg(N().alias("n_used"), F.count_if(F.col("_in").isNull()).alias("n_missing")).withColumn("key", F.lit(key))
        out = line if out is None else out.unionByName(line)
    return out


def shares(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(N().alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # a line per value


def price_distribution(tx: DataFrame) -> DataFrame:
    return tx.agg(*spread(tx, "price", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}))


def duplicates(tx: DataFrame) -> DataFrame:
    return tx.groupBy(*ROW).agg(N().alias("times")).filter("times > 1")


def duplicate_summary(tx: DataFrame) -> DataFrame:
    return duplicates(tx).agg(N().alias("n_groups"), F.coalesce(F.sum("times"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("n_excess"), F.coalesce(F.max("times"), F.lit(0)).alias("largest"))


def duplicate_multiplicity(tx: DataFrame, most: int = 20) -> DataFrame:
    return duplicates(tx).groupBy("times").agg(N().alias("n_groups"), F.sum("times").alias("n_rows")).orderBy("times").limit(most)


def activity(tx: DataFrame, key: str, counted: str) -> DataFrame:
    """Purchases and distinct ``counted`` per key, and how they are spread."""
    per = tx.groupBy(key).agg(N().alias("purchases"), F.count_distinct(counted).alias("spread"))
    return per.agg(N().alias("n"), *spread(per, "purchases", {"median": 0.5, "p90": 0.9, "p99": 0.99}), *spread(per, "spread", {"median": 0.5, "p99": 0.99}))


def concentration(tx: DataFrame, key: str, tops: Sequence[int] = (12, 100, 1000)) -> DataFrame:
    """Spread of purchases per key and the share of the most bought ones. Only the longest top list is ranked."""
    per = tx.groupBy(key).agg(N().alias("purchases"))
    all_ = per.agg(N().alias("n"), F.sum("purchases").alias("_total"), *spread(per, "purchases", {"median": 0.5, "p90": 0.9, "p99": 0.99}))
    best = per.orderBy(F.col("purchases").desc(), key).limit(max(tops))
    ranked = best.withColumn("_r", F.row_number().over(Window.orderBy(F.col("purchases").desc(), key)))
    top = ranked.agg(*[F.sum(F.when(F.col("_r") <= t, F.col("purchases"))).alias(f"_t{t}") for t in tops])
    return all_.crossJoin(top).select("*", *[F.round(100.0 * F.col(f"_t{t}") / F.col("_total"), 4).alias(f"top_{t}_percent") for t in tops]).drop("_total", *[f"_t{t}" for t in tops])


def splits(tx: DataFrame, cutoff: str, start: str, end: str) -> DataFrame:
    d = F.col("transaction_date")
    name = F.when(d <= F.lit(cutoff).cast("date"), "training").when(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")), "validation").otherwise("outside")
    return tx.groupBy(name.alias("split")).agg(N().alias("n_rows"), F.count_distinct("customer_id").alias("n_customers"), F.count_distinct("article_id").alias("n_articles"), F.min(d).alias("first_day"), F.max(d).alias("last_day"))


def coldness(history: DataFrame, target: DataFrame) -> DataFrame:
    """Customers and articles of a target window, and those without history."""
    out = None
    for key, name in (("customer_id", "customers"), ("article_id", "articles")):
        line = target.select(key).distinct().join(history.select(key).distinct().withColumn("_in", F.lit(1)), key, "left").agg(N().alias(f"n_{name}"), F.count_if(F.col("_in").isNull()).alias(f"cold_{name}"))
        out = line if out is None else out.crossJoin(line)
    return out.crossJoin(target.agg(F.count_distinct("customer_id", "article_id").alias("n_pairs")))


def target_spread(target: DataFrame) -> DataFrame:
    per = target.groupBy("customer_id").agg(F.count_distinct("article_id").alias("relevant"), N().alias("_rows"))
    return per.agg(N().alias("n_customers"), *spread(per, "relevant", {"median": 0.5, "p90": 0.9, "p99": 0.99}), F.sum(F.col("_rows") - F.col("relevant")).alias("n_repeats"))


def busiest_days(tx: DataFrame, k: int = 10) -> DataFrame:
    return tx.groupBy("transaction_date").agg(N().alias("n_rows"), F.count_distinct("customer_id").alias("n_customers")).orderBy(F.col("n_rows").desc(), "transaction_date").limit(k)


def top_articles(tx: DataFrame, articles: DataFrame, k: int = 20) -> DataFrame:
    """Names are joined to the k lines that stay."""
    top = tx.groupBy("article_id").agg(N().alias("n_rows"), F.count_distinct("customer_id").alias("n_customers")).orderBy(F.col("n_rows").desc(), "article_id").limit(k)
    return top.join(articles.select("article_id", "prod_name"), "article_id", "left").na.fill("", ["prod_name"])


def text_fields(articles: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Coverage, mean characters and words, and distinct values of text fields."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("c")
    full = ~blank(F.col("v"))
    t = F.trim("v")
    return articles.select(cells).select("c.*").groupBy("field").agg(
        F.count_if(full).alias("n_filled"), F.count_if(~full).alias("n_missing"), r6(F.avg(F.when(full, F.length("v")))).alias("mean_chars"),
        r6(F.avg(F.when(full, F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1))).alias("mean_words"), F.count_distinct(F.when(full, F.col("v"))).alias("n_values"),
    )


def text_examples(articles: DataFrame, field: str, k: int = 3) -> DataFrame:
    return articles.filter(~blank(F.col(field))).groupBy(F.col(field).alias("value")).agg(N().alias("n")).orderBy(F.col("n").desc(), "value").limit(k)

"""Serving as library calls: slates, trends, cards, demo customers, bundles and their checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalar import image_path, padded_keys
from larkspur.operators.candidates import popular_recent
from larkspur.operators.folds import top_rank


def cards(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", F.col("prod_name").alias("name"), F.col("product_type_name").alias("type"), F.col("colour_group_name").alias("colour"), F.col("section_name").alias("section"), image_path(F.col("article_id")).alias("image"))


def trending(tx: DataFrame, articles: DataFrame, cutoff: str, days: int = 7, k: int = 12) -> DataFrame:
    top = popular_recent(tx, cutoff, days, k)
    return cards(articles).join(F.broadcast(top), "article_id")


def lookup(articles: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, article_id): as written, else zero-padded, else without leading zeros, the first that exists."""
    tries = asked.select("asked", F.posexplode(padded_keys(F.col("asked"))).alias("attempt", "key"))
    found = tries.join(articles.select("article_id"), F.col("key") == F.col("article_id").cast("string"))
    return found.groupBy("asked").agg(F.min_by("article_id", "attempt").alias("article_id"))


def source_names(sources: Sequence[str]) -> Column:
    """The sources whose flag is set."""
    return F.array_compact(F.array(*[F.when(F.col(f"is_{s}") == 1, F.lit(s)) for s in sources]))


def recommend(features: DataFrame, score: Callable[[DataFrame], DataFrame], articles: DataFrame, sources: Sequence[str], k: int = 12) -> DataFrame:
    """Scored, ranked, with cards and the sources that named each article."""
    top = top_rank(score(features).withColumn("sources", F.array_join(source_names(sources), ",")), ["customer_id"], [F.round("ranker_score", 9).desc(), "article_id"], k)
    return top.select("customer_id", "article_id", "rank", "sources", "ranker_score").join(cards(articles), "article_id")


def live_or_stored(asked: DataFrame, live: DataFrame, stored: DataFrame) -> DataFrame:
    """Slates of the live store where it has the customer, else the stored ones; ``origin`` tells which, none if neither."""
    a = asked.select("customer_id").distinct().join(live.select("customer_id").distinct().withColumn("_live", F.lit(True)), "customer_id", "left")
    pick = live.withColumn("origin", F.lit("live")).unionByName(stored.join(live.select("customer_id").distinct(), "customer_id", "left_anti").withColumn("origin", F.lit("stored")))
    return a.drop("_live").join(pick, "customer_id", "left").withColumn("origin", F.coalesce("origin", F.lit("none")))


def preferences(slates: DataFrame) -> DataFrame:
    """(customer_id, article_id, score): one over the rank, for search."""
    return slates.filter("rank IS NOT NULL").select("customer_id", "article_id", (1.0 / F.col("rank")).alias("score"))


def demo_customers(buckets: DataFrame, personas: Sequence[str] = ("club_member_status",)) -> DataFrame:
    """The first customer of each persona within each history bucket."""
    return top_rank(buckets, [*personas, "bucket"], ["customer_id"], 1, "place").drop("place")


def write_bundle(features: DataFrame, path: str, buckets: int = 64) -> None:
    """Features by customer bucket, so one customer's are read from one folder."""
    features.withColumn("customer_bucket", F.pmod(F.xxhash64(F.col("customer_id").cast("string")), F.lit(buckets))).write.partitionBy("customer_bucket").parquet(path)


def customer_features(bundle: DataFrame, customer_id: object, buckets: int = 64) -> DataFrame:
    """One customer's rows; only that customer's folder is read."""
    key = bundle.sparkSession.range(1).select(F.pmod(F.xxhash64(F.lit(customer_id).cast("string")), F.lit(buckets)).alias("b")).first()["b"]
    return bundle.filter((F.col("customer_bucket") == int(key)) & (F.col("customer_id") == customer_id))


def bundle_errors(manifest: dict, rows: int, columns: Sequence[str]) -> list[str]:
    """What a bundle lacks of what its manifest says."""
    out = []
    if manifest.get("rows") != rows:
        out.append(f"rows: {manifest.get('rows')} named, {rows} found")
    missing = set(manifest.get("features", [])) - set(columns)
    if missing:
        out.append(f"features missing: {', '.join(sorted(missing))}")
    return out


def readiness(service: str, checks: dict[str, bool], details: dict | None = None) -> tuple[int, dict]:
    """Status code and payload: ready if every check holds."""
    ok = all(checks.values())
    return (200 if ok else 503), {"service": service, "status": "ready" if ok else "not_ready", "checks": checks, **(details or {})}

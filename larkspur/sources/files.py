"""Files in and out: text tables read as strings, candidate files, predictions, embeddings and JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CANDIDATE_COLUMNS = ("source_name", "customer_id", "article_id", "rank", "score", "feature_cutoff")


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV file with a header; every column is a string, so nothing is inferred and nothing is lost."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path)


def typed_transactions(raw: DataFrame) -> DataFrame:
    """Strings to types; what can't be parsed becomes null."""
    return raw.select(
        F.expr("try_cast(t_dat AS date)").alias("transaction_date"),
        "customer_id",
        "article_id",
        F.expr("try_cast(price AS double)").alias("price"),
        F.expr("try_cast(sales_channel_id AS int)").alias("sales_channel_id"),
    )


def fill_blank(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill("", subset=list(columns) if columns else None)


def read_candidates(spark: SparkSession, paths: Sequence[str], known_sources: Sequence[str], restrict_to_base: Sequence[str] = ()) -> DataFrame:
    """Tab-separated candidate files with any of the accepted headers, as one long table.

    Headers may name rank and score per source (``two_tower_rank``) and may lack source or cutoff. Sources in
    ``restrict_to_base`` count only for customers that another source names.
    """
    out = None
    for path in paths:
        raw = spark.read.option("sep", "\t").option("header", True).csv(path)
        pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(None).cast("string"))  # noqa: E731, B023
        part = raw.select(
            F.coalesce(pick("source_name"), F.lit("two_tower")).alias("source_name"),
            "customer_id",
            "article_id",
            pick("rank", "two_tower_rank").cast("int").alias("source_rank"),
            pick("score", "two_tower_score").cast("double").alias("source_score"),
            F.expr("try_cast(" + ("feature_cutoff" if "feature_cutoff" in raw.columns else "NULL") + " AS date)").alias("feature_cutoff"),
        )
        out = part if out is None else out.unionByName(part)
    kept = out.filter(F.col("source_name").isin(*known_sources))
    if not restrict_to_base:
        return kept
    base = kept.filter(~F.col("source_name").isin(*restrict_to_base)).select("customer_id").distinct()
    return kept.join(base, "customer_id", "left_semi").select(*kept.columns)


def write_candidates(candidates: DataFrame, path: str, with_cutoff: bool = True) -> None:
    """Compressed tab-separated candidates, a folder for each source."""
    columns = [F.col("source_name"), F.col("customer_id"), F.col("article_id"), F.col("source_rank").alias("rank"), F.col("source_score").alias("score")]
    columns += [F.col("feature_cutoff")] if with_cutoff else []
    candidates.select(*columns).withColumn("source", F.col("source_name")).write.partitionBy("source").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_predictions(ranked: DataFrame, path: str) -> None:
    """(customer_id, article_id, rank) to a line per customer with its articles in order, space-joined."""
    lists = ranked.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id"))).alias("_r"))
    lists.select("customer_id", F.array_join(F.col("_r.article_id").cast("array<string>"), " ").alias("prediction")).write.option("header", True).csv(path)


def embedding_text(articles: DataFrame) -> DataFrame:
    """What an encoder reads of an article."""
    part = lambda label, c: F.concat(F.lit(label), F.trim(F.coalesce(F.col(c), F.lit(""))))
    return articles.select("article_id", F.concat_ws(" ", F.concat(part("Product: ", "prod_name"), F.lit(".")), part("Description: ", "detail_desc")).alias("text"))


def read_embeddings(spark: SparkSession, path: str, expected_model: str | None = None) -> DataFrame:
    """(id, embedding, status); rows whose status isn't 1 have no vector to search. Refuses another model's vectors."""
    df = spark.read.parquet(path)
    if expected_model and "model" in df.columns and df.filter(F.col("model") != expected_model).limit(1).count():
        raise ValueError(f"{path} has vectors of a model other than {expected_model}")
    return df if "status" in df.columns else df.withColumn("status", F.lit(1))


def resume_order(existing: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Identifiers still to be encoded; refuses state whose identifiers are not those asked for."""
    if existing.select(id_col).subtract(ids.select(id_col)).limit(1).count():
        raise ValueError("the saved state is for other identifiers")
    return ids.join(existing.filter("status <> 0").select(id_col), id_col, "left_anti")


def write_json(spark: SparkSession, path: str, payload: object) -> None:
    """A small document through Hadoop's file system, so any store works."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(json.dumps(payload, indent=2, default=str, sort_keys=True).encode()))
    stream.close()


def markdown_table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(str(v) for v in row) + " |" for row in rows)])

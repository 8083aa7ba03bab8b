"""The three relations that every operator works on, projected from the star schema.

transactions(transaction_date, customer_id, article_id, price, sales_channel_id), a row per purchased unit line;
articles(article_id, prod_name, six category columns); customers(customer_id, two categories, acctbal).
Only columns that a query uses reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Category columns of articles.
CATEGORIES = ("product_type_name", "product_group_name", "colour_group_name", "section_name", "garment_group_name", "department_name")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_linestatus")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("article_id"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linestatus") == "O", 2).otherwise(1).alias("sales_channel_id"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("article_id"),
        F.col("p_name").alias("prod_name"),
        F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("product_type_name"),
        F.col("p_type").alias("product_group_name"),
        F.get(words, F.lit(0)).alias("colour_group_name"),
        F.col("p_brand").alias("department_name"),
        F.concat(F.lit("Section "), F.ceil(F.col("p_size") / 10).cast("string")).alias("section_name"),
        F.concat_ws("/", "p_brand", "p_type").alias("garment_group_name"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer")
    return c.join(nation, c.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("club_member_status"), F.col("n_name").alias("fashion_news_frequency"), F.col("c_acctbal").alias("acctbal")
    )


def register(spark: SparkSession, sf_dir: str) -> None:
    """The relations as temporary views, for SQL users."""
    transactions(spark, sf_dir).createOrReplaceTempView("transactions")
    articles(spark, sf_dir).createOrReplaceTempView("articles")
    customers(spark, sf_dir).createOrReplaceTempView("customers")

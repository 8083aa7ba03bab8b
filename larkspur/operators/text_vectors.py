"""Texts as sparse unit vectors of hashed, idf-weighted words, and search over them.

A sentence encoder's weights are not part of this library; these vectors take its place wherever a text has to be compared with
a text. They are relations (id, bucket, weight), so encoding and searching are joins and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import ranked9
from larkspur.functions.text import tokens
from larkspur.operators.folds import top_rank

WIDTH = 4096


def bucket(token: Column, width: int = WIDTH) -> Column:
    """A token's place, the same in every engine that has md5."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(width))


def counts(rows: DataFrame, id_col: str, text: Column, width: int = WIDTH) -> DataFrame:
    """(id, bucket, tf)."""
    words = rows.select(F.col(id_col), F.explode(tokens(text)).alias("_t"))
    return words.groupBy(id_col, bucket(F.col("_t"), width).alias("bucket")).agg(F.count(F.lit(1)).alias("tf"))


def fit_idf(rows: DataFrame, id_col: str, text: Column, width: int = WIDTH) -> DataFrame:
    """(bucket, idf) over all rows, empty ones too; at most ``width`` lines."""
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n")))
    df = counts(rows, id_col, text, width).groupBy("bucket").agg(F.count(F.lit(1)).alias("_df")).crossJoin(n)
    return df.select("bucket", F.log((F.col("_n") + 1) / (F.col("_df") + 1)).alias("_l")).select("bucket", (F.col("_l") + 1.0).alias("idf"))


def encode(rows: DataFrame, id_col: str, text: Column, idf: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, bucket, weight) of unit length. Words the fitted rows lack have no weight; a text without known words has no rows."""
    w = counts(rows, id_col, text, width).join(F.broadcast(idf), "bucket").select(id_col, "bucket", (F.col("tf") * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "bucket", (F.col("_w") / norm).alias("weight"))


def text_search(queries: DataFrame, items: DataFrame, k: int = 200) -> DataFrame:
    """(query_id, article_id, score, rank) by cosine; pairs without a common word are not made.

    queries: (query_id, bucket, weight), items: (article_id, bucket, weight).
    """
    pairs = queries.select("query_id", "bucket", F.col("weight").alias("_q")).join(items, "bucket")
    scored = pairs.groupBy("query_id", "article_id").agg(F.sum(F.col("_q") * F.col("weight")).alias("score"))
    return top_rank(scored, ["query_id"], [ranked9(F.col("score")).desc(), "article_id"], k)


class TextIndex:
    """A catalogue's texts, encoded once; ``search`` is a channel of the search engine."""

    def __init__(self, articles: DataFrame, text: Column, width: int = WIDTH):
        self.width = width
        self.idf = fit_idf(articles, "article_id", text, width)
        self.items = encode(articles, "article_id", text, self.idf, width)

    def encode_query(self, queries: DataFrame, column: str = "text") -> DataFrame:
        return encode(queries, "query_id", F.col(column), self.idf, self.width)

    def search(self, queries: DataFrame, column: str = "text", k: int = 200) -> DataFrame:
        return text_search(self.encode_query(queries, column), self.items, k)


def picture_query(found: DataFrame, pictures: DataFrame, first: int = 20) -> DataFrame:
    """(query_id, position, value): a text as a point among pictures, the unit mean of the vectors of its ``first`` best articles by text.

    pictures: (article_id, embedding, status); only those of status 1 count, and a query none of whose articles has one gets no rows.
    """
    best = found.filter(F.col("rank") <= first).join(pictures.filter("status = 1").select("article_id", "embedding"), "article_id")
    cells = best.select("query_id", F.posexplode("embedding").alias("position", "x"))
    mean = cells.groupBy("query_id", "position").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("query_id")))
    return mean.select("query_id", F.col("position").cast("long").alias("position"), F.when(norm > 0, F.col("m") / norm).otherwise(0.0).alias("value"))

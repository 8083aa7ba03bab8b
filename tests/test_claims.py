"""Functions that no registered query reaches, on small data."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions.scalar import primary_source, search_text
from larkspur.operators import features, folds, search, vectors
from larkspur.plans import candidates
from larkspur.sources import relations


def test_approximate_neighbours_are_mostly_the_exact_ones(spark):
    row = candidates.QUERIES["ann_diagnostics"](spark, "/root/testdata/sf0.01").first()
    assert row.overlap >= 0.9  # recall; the tenth neighbour is as good for 0.65 of the queries


def test_first_k_settles_ties_by_place():
    scores = np.array([0.5, 0.9, 0.5 + 1e-12, -np.inf, 0.9, 0.1])
    assert vectors.first_k(scores, 3).tolist() == [1, 4, 0]
    assert vectors.first_k(scores, 10).tolist() == [1, 4, 0, 2, 5]
    assert vectors.first_k(scores, 2, np.array([1])).tolist() == [4, 0]


def test_blocks_equal_joined_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    users, items = spark.createDataFrame(rows[:15], "customer_id long, embedding array<double>"), spark.createDataFrame(rows, "article_id long, embedding array<double>")
    shape = lambda df: sorted((r.customer_id, r.source_rank, r.article_id, round(r.source_score, 6)) for r in df.collect())
    got = shape(vectors.exact_neighbours(users, items, 5))
    monkeypatch.setattr(vectors, "MATRIX", 1)
    assert shape(vectors.exact_neighbours(users, items, 5)) == got and len(got) == 75


def test_content_in_blocks_equals_join_by_token(spark, data, monkeypatch):
    query = candidates.QUERIES["content_candidates"]
    shape = lambda df: sorted(map(tuple, df.select("customer_id", "source_rank", "article_id", F.round("source_score", 6)).collect()))
    got = shape(query(spark, data))
    monkeypatch.setattr(candidates.c, "CATALOGUE", 1)
    assert shape(query(spark, data)) == got and got


def test_normalised_features(spark):
    rows = spark.createDataFrame([(None, 0.0), (3, 2.0), (8, 4.0)], "times_bought_item long, x double")
    fitted = {r.feature: (r["mean"], r["std"]) for r in features.fit_normaliser(rows, ["times_bought_item", "x"]).collect()}
    out = features.normalise(rows, fitted).collect()
    logs = [0.0, math.log1p(3), math.log1p(8)]
    spread = np.std(logs)
    assert [r.times_bought_item for r in out] == pytest.approx([(v - np.mean(logs)) / spread for v in logs])
    assert [r.x for r in out] == pytest.approx([(v - 2) / np.std([0, 2, 4]) for v in (0, 2, 4)])


def test_month_folds(spark):
    got = [tuple(map(str, r)) for r in folds.month_folds(spark, ["2000-01-31", "2000-02-28"]).collect()]
    assert got == [("1", "2000-01-31", "2000-02-01", "2000-02-28"), ("2", "2000-02-28", "2000-02-29", "2000-03-27")]


def test_primary_source(spark):
    rows = spark.createDataFrame([(1, 0), (0, 1), (1, 1), (0, 0)], "a int, b int")
    assert [r[0] for r in rows.select(primary_source([("a", F.col("a")), ("b", F.col("b"))])).collect()] == ["a", "b", "multi_source", "none"]


def test_recorded_scores_against_recomputed(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k long, recorded double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.5)], "k long, recomputed double")
    assert tuple(vectors.alignment(a, b, ["k"]).first()) == (2, 0.25, 0.125)


def test_judgements_are_checked(spark):
    expected = spark.createDataFrame([("q", 1), ("q", 2)], "query_id string, article_id long")
    good = spark.createDataFrame([("q", 1, 3), ("q", 2, 0)], "query_id string, article_id long, relevance int")
    bad = spark.createDataFrame([("q", 1, 4), ("q", 1, 2), ("q", 9, None)], "query_id string, article_id long, relevance int")
    assert search.validate_judgements(good, expected) == []
    assert search.validate_judgements(bad, expected) == ["missing", "unknown", "repeated", "grade"]


def test_suggestions_are_checked_and_merged():
    payload = {"reformulated_query": "Soft cotton", "style_terms": ["soft", "soft"], "exclusions": []}
    soft = search.soft_intent(payload, {"soft", "cotton", "red"}, ["shirt"], {"red"})
    assert soft == {"reformulated_query": "soft cotton", "style_terms": ["soft"], "exclusions": []}
    for wrong in ({}, {**payload, "style_terms": ["red"]}, {**payload, "exclusions": "soft"}, {**payload, "reformulated_query": "soft 1234567"}, {**payload, "style_terms": ["soft"] * 9}):
        with pytest.raises(ValueError):
            search.soft_intent(wrong, {"soft", "cotton", "red"}, ["shirt"], {"red"})
    out = search.merge_soft({"semantic_query": "shirt", "style_terms": "plain", "exclusions": "", "color": "Red"}, soft)
    assert out == {"semantic_query": "shirt soft cotton", "style_terms": "plain soft", "exclusions": "", "color": "Red"}


def test_search_engine_from_text_to_result(spark, data):
    articles = relations.articles(spark, data)
    text = search_text(["prod_name", "product_group_name"])
    one = articles.filter("product_type_name <> ''").orderBy("article_id").first()
    queries = spark.createDataFrame([(1, f"{one.colour_group_name} {one.product_type_name}")], "query_id long, text string")
    found = search.SearchEngine(articles, text, search.catalogue_aliases(articles)).search(queries, 10).collect()
    assert found and [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, len(found) + 1))
    named = {r.article_id for r in articles.filter((F.col("product_type_name") == one.product_type_name) & (F.col("colour_group_name") == one.colour_group_name)).collect()}
    assert {r.article_id for r in found} <= named


def test_relations_as_views(spark, data):
    relations.register(spark, data)
    assert spark.sql("SELECT count(*) FROM transactions").first()[0] == spark.read.parquet(f"{data}/lineitem.parquet").count()


def _broadcasts(df):
    """The subtrees of a plan below its broadcast exchanges."""
    lines = df._jdf.queryExecution().sparkPlan().treeString().splitlines()
    depth = [len(re.match(r"[ :+\-]*", x)[0]) for x in lines]
    joins = [i for i, x in enumerate(lines) if "Broadcast" in x and "Join" in x]
    out = []
    for i in joins:
        sides = [j for j in range(i + 1, len(lines)) if depth[j] == depth[i] + 3 and all(x > depth[i] for x in depth[i + 1 : j + 1])]
        built = sides[0] if "BuildLeft" in lines[i] else sides[1]
        end = next((j for j in range(built + 1, len(lines)) if depth[j] <= depth[built]), len(lines))
        out.append("\n".join(lines[built:end]))
    return out


def test_tokens_of_a_catalogue_are_not_broadcast(spark, data):
    profiles = candidates.QUERIES["content_profiles"](spark, data)
    assert not [x for x in _broadcasts(profiles) if "Generate" in x]


def test_articles_with_the_same_tokens_are_sent_once(spark, monkeypatch):
    day = "1998-01-01"
    fields = "product_type_name string, product_group_name string, colour_group_name string, section_name string, garment_group_name string, department_name string"
    articles = spark.createDataFrame([(i, *(f"{c}{i % 3}" if c != "e" or i % 3 else "" for c in "abcdef")) for i in range(60)], f"article_id long, {fields}")
    tx = spark.createDataFrame([(1, 0, day), (1, 3, day), (1, 1, day), (2, 5, day)], "customer_id long, article_id long, transaction_date string").withColumn("transaction_date", F.to_date("transaction_date"))
    shape = lambda df: sorted(map(tuple, df.select("customer_id", "source_rank", "article_id", F.round("source_score", 6)).collect()))
    found = lambda: shape(candidates.c.content(tx, tx.select("customer_id"), articles, day, k=25, oversample=4))
    monkeypatch.setattr(candidates.c, "CATALOGUE", 0)
    joined = found()
    sent = []
    monkeypatch.setattr(candidates.c, "CATALOGUE", 3)  # 60 articles, three sets of tokens
    blocks = candidates.c._content_blocks
    monkeypatch.setattr(candidates.c, "_content_blocks", lambda *a: sent.append(1) or blocks(*a))
    assert found() == joined and len(joined) == 25 + 19 and sent


def test_search_broadcasts_no_postings_and_no_catalogue(spark, data):
    from larkspur.plans import search as plans

    a = relations.articles(spark, data)
    queries = spark.createDataFrame([(1, "red widget")], "query_id long, text string")
    lexical = search.bm25_search(queries, a, "article_id", search_text(plans.TEXT_FIELDS))
    assert not [x for x in _broadcasts(lexical) if re.search(r"keys=\[doc|AS length", x.splitlines()[0])]
    structured = search.structured_search(search.parse_intent(queries, search.catalogue_aliases(a)), a)
    assert not [x for x in _broadcasts(structured) if "_key" in x.splitlines()[0] and "article_id" in x.splitlines()[0]]
    nested = [x for x in plans.judged(spark, data)._jdf.queryExecution().sparkPlan().treeString().splitlines() if "BroadcastNestedLoopJoin" in x and "product_type" in x]
    assert nested and all("BuildRight" in x for x in nested)


def test_slabs_of_articles_give_the_exact_best(spark):
    rng = np.random.default_rng(3)
    rows = lambda n, name: spark.createDataFrame([(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(n)], f"{name} int, embedding array<float>")
    users, items = rows(40, "customer_id"), rows(300, "article_id")
    key = lambda d: sorted((r.customer_id, r.source_rank, r.article_id, r.source_score) for r in d.collect())
    want = key(vectors.exact_neighbours(users, items.withColumn("article_id", items.article_id.cast("long")), 25))
    assert len(want) == 1000
    for cells in (100, 500, 10_000):
        assert key(vectors.rank_slabs(users, "customer_id", items, 25, cells)) == want
    assert vectors.rank_slabs(users, "customer_id", items.limit(0), 25).count() == 0


def test_factors_are_made_in_whole_rounds_of_the_cores(spark, monkeypatch):
    from pyspark.ml.recommendation import ALS

    fits = []
    fit = ALS._fit
    monkeypatch.setattr(ALS, "_fit", lambda self, rows: fits.append((self.getNumUserBlocks(), self.getNumItemBlocks(), rows.count())) or fit(self, rows))
    day = "1998-01-01"
    tx = spark.createDataFrame([(c, (c * 7 + i) % 20, day) for c in range(30) for i in range(4)] + [(0, 0, day)], "customer_id int, article_id int, day string").select("customer_id", "article_id", F.to_date("day").alias("transaction_date"))
    got = candidates.c.als(tx, tx.filter("customer_id < 9"), day, rank=4, iterations=2, k=20).collect()
    assert len(got) == 9 * 20 and [n for *_, n in fits] == [120]
    cores = spark.sparkContext.defaultParallelism
    assert all(n % cores == 0 and cores <= n for n in fits[0][:2])

"""Hand-computed metrics, folds and search rules."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions.text import one_edit
from larkspur.operators import folds, metrics, search
from larkspur.plans.evaluation import popularity_baseline


def ap(spark, relevant, predicted, k=12):
    lab = spark.createDataFrame([("c", a) for a in relevant], "customer_id string, article_id string")
    pred = spark.createDataFrame([("c", a, i) for i, a in enumerate(predicted, 1)], "customer_id string, article_id string, rank long")
    return metrics.average_precision(lab, pred, k).first()["ap"]


@pytest.mark.parametrize(
    ("relevant", "predicted", "want"),
    [
        ("ab", "ab", 1.0), ("a", "bc", 0.0), ("c", "abc", 1 / 3), ("a", "aa", 1.0), ("z", "abcdefghijklz", 0.0), ("abcdefghijklm", "abcdefghijkl", 1.0),
    ],
)
def test_average_precision(spark, relevant, predicted, want):
    assert ap(spark, relevant, predicted) == pytest.approx(want)


def test_ranking_metrics(spark):
    lab = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "customer_id string, article_id string")
    pred = spark.createDataFrame([("x", "a", 1), ("x", "d", 2), ("y", "d", 1), ("y", "c", 2), ("z", "b", 1)], "customer_id string, article_id string, rank long")
    m = metrics.ranking_metrics(lab, pred, 4).first()
    assert (m.map_at_k, m.macro_recall_at_k, m.hit_rate_at_k, m.coverage_at_k) == (0.5, 0.75, 1.0, 0.75)
    assert m.micro_recall_at_k == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="catalogue"):
        metrics.ranking_metrics(lab, pred, 0)


def test_retrieval_metrics_without_candidates(spark):
    lab = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "customer_id string, article_id string")
    none = spark.createDataFrame([], "customer_id string, article_id string, rank long")
    rows = {r.k: r for r in metrics.retrieval_metrics(lab, none, (2, 4)).collect()}
    assert rows[2].macro_recall == rows[4].macro_recall == 0
    some = spark.createDataFrame([("x", "a", 1), ("x", "q", 2), ("x", "b", 3), ("y", "c", 2)], "customer_id string, article_id string, rank long")
    rows = {r.k: (r.macro_recall, r.matched_pairs) for r in metrics.retrieval_metrics(lab, some, (2, 4)).collect()}
    assert rows == {2: (0.75, 2), 4: (1.0, 3)}


def test_empty_labels_give_no_customers(spark):
    lab = spark.createDataFrame([], "customer_id string, article_id string")
    pred = spark.createDataFrame([("x", "a", 1)], "customer_id string, article_id string, rank long")
    m = metrics.ranking_metrics(lab, pred, 4).first()
    assert m.customers == 0 and m.map_at_k is None


def test_weekly_windows(spark):
    rows = folds.weekly_windows(spark, "2020-09-22", 3).orderBy("fold").collect()
    assert [str(r.train_end) for r in rows] == ["2020-09-01", "2020-09-08", "2020-09-15"]
    assert [str(r.target_start) for r in rows] == ["2020-09-02", "2020-09-09", "2020-09-16"]
    assert [str(r.recent_start) for r in rows] == ["2020-08-26", "2020-09-02", "2020-09-09"]
    with pytest.raises(ValueError, match="positive"):
        folds.weekly_windows(spark, "2020-09-22", 0)


def test_popularity_baseline(spark):
    rows = [("2020-09-01", "x", "a"), ("2020-09-02", "y", "a"), ("2020-09-03", "x", "b"), ("2020-09-10", "x", "a"), ("2020-09-11", "x", "c"), ("2020-09-11", "z", "b")]
    tx = spark.createDataFrame(rows, "d string, customer_id string, article_id string").withColumn("transaction_date", F.col("d").cast("date"))
    catalogue = spark.createDataFrame([("a",), ("b",), ("c",)], "article_id string")
    m = {r.segment: r for r in popularity_baseline(tx, catalogue, "2020-09-08", "2020-09-09", "2020-09-15", k=2).collect()}
    assert (m["overall"].map_at_k, m["overall"].customers) == (0.5, 2)
    assert (m["warm"].map_at_k, m["cold"].map_at_k) == (0.5, 0.5)
    assert m["overall"].micro_recall_at_k == pytest.approx(2 / 3)
    assert m["overall"].coverage_at_k == pytest.approx(2 / 3)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("blue", "blue", True), ("bleu", "blue", True), ("blu", "blue", True), ("bluee", "blue", True), ("blux", "blue", False), ("lbue", "blue", True), ("xlue", "blue", False), ("ab", "abc", False), ("hot", "htoo", False), ("lue", "blue", False), ("a", "a", True)],
)
def test_one_edit(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(one_edit(F.col("a"), F.col("b"))).first()[0] is want


def test_intents(spark):
    q = spark.createDataFrame([(1, "black hoodie for men"), (2, "blue summer vibes"), (3, "dress not linen but cotton"), (4, "blck dress"), (5, "")], "query_id long, text string")
    rows = {r.query_id: r for r in search.parse_intent(q, search.alias_table(spark)).collect()}
    assert (rows[1].color, rows[1].product_type, rows[1].section, rows[1].hard_color) == ("Black", "Hoodie", "Menswear", True)
    assert (rows[2].color, rows[2].product_type, rows[2].hard_color, rows[2].style_terms) == ("Blue", None, False, "summer")
    assert (rows[3].exclusions, rows[3].style_terms) == ("linen cotton", "")
    assert (rows[4].color, rows[4].semantic_query) == ("Black", "black dress")
    assert rows[5].tokens == [] and rows[5].color is None


def test_soft_suggestions():
    ok = search.soft_intent({"reformulated_query": "warm cotton", "style_terms": ["cotton", "cotton"], "exclusions": []}, {"warm", "cotton"}, ["dress"], {"dress", "blue"})
    assert ok["style_terms"] == ["cotton"]
    for bad in ({"reformulated_query": "blue", "style_terms": [], "exclusions": []}, {"style_terms": [], "exclusions": []}, {"reformulated_query": None, "style_terms": ["warm"] * 9, "exclusions": []}):
        with pytest.raises(ValueError, match="."):
            search.soft_intent(bad, {"warm", "blue"}, ["dress"], {"dress", "blue"})
    merged = search.merge_soft({"style_terms": "summer", "exclusions": "", "semantic_query": "dress", "product_type": "Dress"}, ok)
    assert merged["semantic_query"].startswith("dress warm cotton") and merged["product_type"] == "Dress"

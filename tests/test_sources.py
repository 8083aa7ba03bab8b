"""Files in and out, budgets, samples, serving helpers, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import features, merge, serving, vectors
from larkspur.sources import files


def test_csv_strings(spark, tmp_path):
    (tmp_path / "t.csv").write_text("t_dat,customer_id,article_id,price,sales_channel_id\n2020-01-02,c,0001,0.5,1\nbad,c,0002,x,\n")
    raw = files.read_csv_strings(spark, str(tmp_path / "t.csv"), ["t_dat", "customer_id", "article_id", "price", "sales_channel_id"])
    a, b = files.typed_transactions(raw).orderBy("article_id").collect()
    assert (str(a.transaction_date), a.article_id, a.price, a.sales_channel_id) == ("2020-01-02", "0001", 0.5, 1)
    assert (b.transaction_date, b.price, b.sales_channel_id) == (None, None, None)


def test_candidate_files(spark, tmp_path):
    base = spark.createDataFrame([("c", "a", "als", 1, 0.5), ("c", "b", "other", 1, 0.1)], "customer_id string, article_id string, source_name string, source_rank int, source_score double").withColumn("feature_cutoff", F.lit("2020-01-01").cast("date"))
    files.write_candidates(base, str(tmp_path / "base"))
    (tmp_path / "tt.tsv").write_text("customer_id\tarticle_id\ttwo_tower_score\ttwo_tower_rank\tsource_two_tower\tfeature_cutoff\nc\tz\t0.9\t1\t1\t2020-01-01\nd\tz\t0.9\t1\t1\t2020-01-01\n")
    got = files.read_candidates(spark, [str(tmp_path / "base" / "source=*"), str(tmp_path / "tt.tsv")], ["als", "two_tower"], ["two_tower"])
    assert sorted((r.source_name, r.customer_id, r.article_id, r.source_rank) for r in got.collect()) == [("als", "c", "a", 1), ("two_tower", "c", "z", 1)]


def test_predictions_and_json(spark, tmp_path):
    ranked = spark.createDataFrame([("c", "b", 2), ("c", "a", 1)], "customer_id string, article_id string, rank long")
    files.write_predictions(ranked, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).first().prediction == "a b"
    files.write_json(spark, str(tmp_path / "m.json"), {"a": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1}
    assert files.markdown_table(["x"], [[1]]) == "| x |\n| --- |\n| 1 |"


def test_resume_refuses_other_identifiers(spark):
    ids = spark.createDataFrame([(1,), (2,)], "article_id long")
    state = spark.createDataFrame([(1, 1)], "article_id long, status int")
    assert [r.article_id for r in files.resume_order(state, ids, "article_id").collect()] == [2]
    with pytest.raises(ValueError, match="other"):
        files.resume_order(spark.createDataFrame([(9, 1)], "article_id long, status int"), ids, "article_id")


def test_budget_keeps_ranks_and_drops_pairs(spark):
    rows = [("c", "a", 1, 1, 0.002, 0.5, 1, 60, 0.12, 0.1), ("c", "b", 0, None, None, None, 1, 60, 0.12, 0.1)]
    f = spark.createDataFrame(rows, "customer_id string, article_id string, is_x int, rank_x int, rank_pct_x double, score_x double, is_y int, rank_y int, rank_pct_y double, score_y double")
    out = merge.apply_budget(f, ["x", "y"], "y", 50).collect()
    assert [(r.article_id, r.is_y, r.rank_y, r.num_sources) for r in out] == [("a", 0, None, 1)]


def test_downsample(spark):
    rows = [("c", i, int(i == 0), float(i)) for i in range(20)]
    f = spark.createDataFrame(rows, "customer_id string, article_id long, label int, h double")
    out = features.downsample(f, F.col("h"), 3, 4, 1).collect()
    assert len(out) == 8 and {r.article_id for r in out} >= {0, 19, 18, 17}
    again = features.downsample(f, F.col("h"), 3, 4, 1).collect()
    assert {r.article_id for r in out} == {r.article_id for r in again}


def test_cell_index_agrees_when_all_cells_are_probed(spark):
    items = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "article_id long, embedding array<float>")
    users = spark.createDataFrame([(1, [1.0, 0.5, 0.1]), (2, [-1.0, 0.2, 0.0])], "customer_id long, embedding array<float>")
    exact = vectors.exact_neighbours(users, items, 5)
    found = vectors.CellIndex(items, cells=4, probes=4).search(users, 5)
    d = vectors.compare_neighbours(found, exact, 5).first()
    assert (d.overlap, d.mean_regret, d.as_good) == (1.0, 0.0, 1.0)


def test_bundles(spark, tmp_path):
    f = spark.createDataFrame([(1, 10), (2, 20)], "customer_id long, article_id long")
    serving.write_bundle(f, str(tmp_path / "b"))
    assert [r.article_id for r in serving.customer_features(spark.read.parquet(str(tmp_path / "b")), 2).collect()] == [20]
    assert serving.bundle_errors({"rows": 3, "features": ["x"]}, 2, ["y"]) == ["rows: 3 named, 2 found", "features missing: x"]
    assert serving.readiness("s", {"a": True, "b": False})[0] == 503


def test_stream_of_a_table_in_many_files_and_any_zone(spark, data, tmp_path):
    from larkspur.plans import search

    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    expected = sorted(map(str, spark.sql(f"SELECT date_from_unix_date(cast(floor(datediff(ts, DATE '1970-01-01') / 7) * 7 AS int)), get_json_object(props, '$.k'), count(*) FROM parquet.`{data}/events.parquet` WHERE event_type = 'purchase' GROUP BY 1, 2").select(F.struct("*").cast("string")).toPandas().iloc[:, 0]))
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for folder in (data, str(tmp_path)):
                got = search.QUERIES["stream_trending"](spark, folder).select(F.struct("*").cast("string")).toPandas()
                assert sorted(map(str, got.iloc[:, 0])) == expected
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stream_at_the_edges_of_weeks_and_without_times(spark, tmp_path):
    import duckdb

    from larkspur.plans import search
    from tests.compare import both

    times = ["'2024-01-03 23:59:59.4'", "'2024-01-03 23:59:59.5'", "'2024-01-03 23:59:59.7'", "'2024-01-04 00:00:00'", "'1969-12-31 23:59:59'", "'1969-12-25 12:00:00'", "'1969-12-24 23:00:00'", "NULL", "NULL"]
    con = duckdb.connect()
    rows = ", ".join(f"({i}::BIGINT, {t}::TIMESTAMP, 1::BIGINT, 'purchase', 1.0::DOUBLE, '{{\"k\": 5}}')" for i, t in enumerate(times))
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) AS e(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = both(con, search.QUERIES["stream_trending"](spark, str(tmp_path)), search.ORACLES["stream_trending"])
    assert got == want

"""Networks against finite differences, small lists learned by heart, text vectors, frozen rankings and the search study."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import neural, search, text_vectors
from larkspur.operators.rankers import TwoTower, fit_from_spec, slate
from larkspur.plans import experiments


def _slopes(loss, params, eps=1e-6):
    out = {}
    for name, value in params.items():
        g = np.zeros_like(value)
        for at in np.ndindex(value.shape):
            old = value[at]
            value[at] = old + eps
            up = loss()
            value[at] = old - eps
            g[at] = (up - loss()) / (2 * eps)
            value[at] = old
        out[name] = g
    return out


def _lists(seed=3, n=5, m=6, features=4, values=3):
    rng = np.random.default_rng(seed)
    mask = np.ones((n, m), bool)
    mask[0, 4:] = False
    labels = np.zeros((n, m))
    labels[np.arange(n), rng.integers(0, 4, n)] = 1
    return neural.Lists(rng.normal(size=(n, m, features)), rng.integers(0, values + 1, (n, m, 1)), labels, mask)


def test_gradients_of_the_list_network():
    lists, rng = _lists(), np.random.default_rng(0)
    p = neural.list_params(4, rng, hidden=5)
    loss = lambda: neural.listnet(neural.list_forward(p, lists.x, lists.mask)[0], lists.labels, lists.mask)[0]
    scores, kept = neural.list_forward(p, lists.x, lists.mask)
    got = neural.list_backward(p, kept, lists.x, neural.listnet(scores, lists.labels, lists.mask)[1])
    for name, want in _slopes(loss, p).items():
        np.testing.assert_allclose(got[name], want, atol=1e-6)


def test_gradients_of_the_cross_network():
    lists, rng = _lists(), np.random.default_rng(0)
    x, c = lists.x.reshape(-1, 4), lists.categories.reshape(-1, 1)
    p = neural.cross_params(4, [4], rng, hidden=5, width=2)
    better, worse = np.array([0, 1, 8, 8]), np.array([5, 9, 3, 2])
    loss = lambda: neural.pair_loss(*(neural.cross_forward(p, x, c)[0][at] for at in (better, worse)))[0]
    scores, kept = neural.cross_forward(p, x, c)
    g = neural.pair_loss(scores[better], scores[worse])[1]
    got = neural.cross_backward(p, kept, c, np.bincount(better, g, len(scores)) - np.bincount(worse, g, len(scores)), 4)
    for name, want in _slopes(loss, p).items():
        np.testing.assert_allclose(got[name], want, atol=1e-6)


def test_list_loss_passes_over_empty_lists_and_masked_rows():
    scores, labels = np.array([[2.0, 1.0, 9.0], [0.0, 0.0, 0.0]]), np.array([[1.0, 0.0, 1.0], [0.0, 0.0, 0.0]])
    mask = np.array([[True, True, False], [True, True, True]])
    loss, g = neural.listnet(scores, labels, mask)
    assert loss == pytest.approx(np.log(1 + np.exp(-1)))
    assert not g[1].any() and g[0, 2] == 0 and g[0].sum() == pytest.approx(0)


@pytest.mark.parametrize("kind", ["cross", "list"])
def test_networks_learn_a_few_lists_by_heart(kind):
    first, last = neural.memorises(kind, _lists(), ["a", "b", "c", "d"], [{"x": 1, "y": 2, "z": 3}])
    assert last < 0.1 < first


def test_mean_average_precision_of_lists():
    lists = neural.Lists(np.zeros((2, 3, 1)), np.zeros((2, 3, 0), int), np.array([[0, 1, 0], [1, 0, 1.0]]), np.array([[1, 1, 1], [1, 1, 0]], bool))
    assert neural.mean_ap(np.array([[3, 2, 1], [3, 2, 1.0]]), lists) == pytest.approx((0.5 + 1) / 2)


@pytest.mark.parametrize("kind", ["cross", "list"])
def test_networks_rank_in_spark(spark, kind):
    rng = np.random.default_rng(1)
    rows = [(c, a, float(x), None if a == 3 else float(rng.normal()), int(x > 1.2), 1 + a % 2, f"k{a % 3}") for c in range(60) for a, x in enumerate(rng.normal(size=12))]
    pairs = spark.createDataFrame(rows, "customer_id long, article_id long, x double, noise double, label int, num_sources int, kind string")
    spec = {"family": kind, "options": {"epochs": 40, "rate": 0.01, "categories": ["kind"], "size": 10}}
    scored = fit_from_spec(pairs, ["x", "noise"], spec).score(pairs)
    assert scored.count() == len(rows) and scored.filter("ranker_score IS NULL OR isnan(ranker_score)").count() == 0
    assert scored.filter("ranker_score < -1e5").count() == 60 * 2  # behind the shortlist
    first = slate(scored, k=1).filter("ranker_score > -1e5").join(pairs.groupBy("customer_id").agg(F.max("label").alias("any")), "customer_id").filter("any = 1")
    assert first.agg(F.avg("label")).first()[0] > 0.7
    with pytest.raises(ValueError, match="positive"):
        fit_from_spec(pairs.withColumn("label", F.lit(0)), ["x"], spec)


def _towers():
    rng = np.random.default_rng(0)
    tokens = np.array([[i % 4, 4 + i] for i in range(24)])
    groups = [[i for i in range(24) if i % 4 == g] for g in range(4)]
    rows = [(list(map(int, rng.choice(groups[g], 3, replace=False))), int(rng.choice(groups[g]))) for g in rng.integers(0, 4, 400)]
    return [(h, [1 / 3] * 3) for h, _ in rows], [p for _, p in rows], tokens


def test_towers_stop_at_the_least_held_loss():
    h, p, tokens = _towers()
    options = {"width": 8, "epochs": 40, "negatives": 16, "rate": 0.3, "patience": 2}
    model = TwoTower(**options).fit(h[80:], p[80:], tokens, (h[:80], p[:80]))
    assert model.best_epoch == int(np.argmin(model.held_losses)) + 1
    assert model.loss(h[:80], p[:80], tokens) == pytest.approx(min(model.held_losses))
    gap = model.similarity_gap(h[:80], p[:80], tokens)
    assert gap["gap"] == pytest.approx(gap["positive"] - gap["random"]) and gap["gap"] > 0.3


def test_towers_can_overfit():
    tokens = np.arange(40)[:, None]
    h, p = [([i], [1.0]) for i in range(20)], list(range(20, 40))
    good = TwoTower.overfits(h, p, tokens, epochs=300, width=16, rate=1.0, negatives=8)
    assert good["passes"] and good["top1"] == 1.0
    assert not TwoTower.overfits(h, p, tokens, epochs=1, width=16, rate=0.0, negatives=8)["passes"]


def test_text_vectors_find_texts(spark):
    rows = [(1, "red cotton shirt"), (2, "blue linen trousers"), (3, "red linen shirt"), (4, ""), (5, None), (6, "unheard")]
    items = spark.createDataFrame(rows, "article_id long, text string")
    index = text_vectors.TextIndex(items, F.col("text"))
    assert {r.article_id: round(r.n, 9) for r in index.items.groupBy("article_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()} == {1: 1, 2: 1, 3: 1, 6: 1}
    queries = spark.createDataFrame([(1, "red cotton shirt"), (2, "linen"), (3, "nothing known"), (4, None)], "query_id long, text string")
    found = {(r.query_id, r["rank"]): (r.article_id, r.score) for r in index.search(queries).collect()}
    assert found[1, 1] == (1, pytest.approx(1.0)) and found[1, 2][0] == 3 and {q for q, _ in found} == {1, 2}
    pictures = spark.createDataFrame([(1, [3.0, 4.0], 1), (3, [3.0, 4.0], 1), (2, [1.0, 0.0], 2)], "article_id long, embedding array<double>, status int")
    got = {(r.query_id, r.position): round(r.value, 6) for r in text_vectors.picture_query(index.search(queries), pictures).collect()}
    assert got == {(q, i): v for q in (1, 2) for i, v in ((0, 0.6), (1, 0.8))}


def test_frozen_rankings_are_checked():
    good = {"rankings": {"a": ["1", "2"], "b": ["2", "3"]}}
    assert search.frozen_rankings("q", good, ["a", "b"]) == (good["rankings"], {"1", "2", "3"})
    for row in ({}, {"rankings": {"a": []}}, {"rankings": {"a": ["1", "1"], "b": []}}, {"rankings": {"a": [1], "b": []}}, {"rankings": {"a": "1", "b": []}}):
        with pytest.raises(ValueError, match="'q'"):
            search.frozen_rankings("q", row, ["a", "b"])


def test_search_study_keeps_what_gains(spark):
    rows = [(q, a, 3 if a % 5 == 0 else a % 2, float(a % 5 == 0), float(-(a % 5 == 0) + a * 0.01)) for q in range(24) for a in range(15)]
    pairs = spark.createDataFrame(rows, "query_id long, article_id long, relevance int, f_good double, bad double").withColumn("rank", F.lit(1))
    got = experiments.search_study(pairs.drop("rank"), ["f_good"], "bad", trees=2, depth=2).first()
    assert got.kept and got.learned_ndcg > got.base_ndcg and 0 < got.queries < 24
    same = experiments.search_study(pairs.drop("rank"), ["f_good"], "f_good", trees=2, depth=2).first()
    assert not same.kept


def test_tables_are_built_once(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    got = [experiments.load_or_build(spark, f"{tmp_path}/t", build).count() for _ in range(2)]
    assert got == [3, 3] and len(built) == 1


def test_a_batch_of_two_towers_touches_only_its_own_items():
    class Watched(np.ndarray):
        most = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                Watched.most = max(Watched.most, at.size)
            return np.asarray(super().__getitem__(at))

    rng = np.random.default_rng(4)
    tokens = np.stack([rng.integers(0, 20, 5000), 20 + rng.integers(0, 30, 5000)], axis=1)
    histories = [([3, 9, 3], [0.5, 0.25, 0.25]), ([], []), ([4000], [1.0])]
    model = TwoTower(width=4, negatives=6, rate=1.0)
    start = rng.normal(0, 1, (50, 4))
    call = lambda table, learn: (setattr(model, "table", table), model._batch(np.arange(3), histories, [7, 8, 9], tokens, np.random.default_rng(1), learn))[1]
    moved = start.copy().view(Watched)
    loss = call(moved, True)
    assert Watched.most <= 2 * (4 + 3 + 6)
    for i, j in ((tokens[3, 0], 1), (tokens[7, 1], 2), (tokens[4000, 0], 0)):
        near = start.copy()
        near[i, j] += 1e-6
        assert (call(near, False) - loss) / 1e-6 / 3 == pytest.approx(float(start[i, j] - np.asarray(moved)[i, j]), abs=1e-4)


def test_towers_train_on_all_examples(monkeypatch):
    seen = []
    monkeypatch.setattr(TwoTower, "_batch", lambda self, part, *rest: seen.extend(part) or 0.0)
    TwoTower(epochs=1).fit([([0], [1.0])] * 50_050, [1] * 50_050, np.arange(2)[:, None])
    assert sorted(seen) == list(range(50_050))


def test_towers_by_tokens_equal_towers_by_items():
    from larkspur.operators import rankers

    rng = np.random.default_rng(8)
    tokens = np.stack([rng.integers(0, 9, 60), rng.integers(5, 20, 60), rng.integers(5, 20, 60)], axis=1)
    table, flat, row = rng.normal(0, 1, (20, 5)), rng.integers(0, 60, 33), np.sort(rng.choice([0, 1, 3], 33))
    a, b = (kind(table, flat, rng2.uniform(0.1, 1, 33), row, 4, tokens) for kind, rng2 in ((rankers._by_tokens, np.random.default_rng(1)), (rankers._by_items, np.random.default_rng(1))))
    assert np.allclose(a.users, b.users) and not a.users[2].any()
    gu, full = rng.normal(0, 1, (4, 5)), np.zeros((2, 20, 5))
    for line, towers in zip(full, (a, b), strict=True):
        to, rows = towers.gradient(gu)
        line[to] = rows
    assert np.allclose(*full)


def test_two_towers_train_on_all_customers_in_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from larkspur.operators import rankers

    fields = [f"{c} string" for c in ("product_type_name", "product_group_name", "colour_group_name", "section_name", "garment_group_name", "department_name")]
    articles = spark.createDataFrame([(i, *(f"{c}{i % 12}" for c in "abcde"), "" if i % 3 else "f") for i in range(48)] + [(99, *[""] * 6)], f"article_id long, {', '.join(fields)}")
    rng = np.random.default_rng(2)
    rows = [(c, int(a), f"2001-01-{d:02}") for c in range(90) for d, a in enumerate(rng.choice(np.arange(c % 12, 40, 12), 3, replace=False), 1)] + [(5, 99, "2001-01-09"), (7, 1000, "2001-01-09"), (200, 3, "2001-01-01")]
    tx = spark.createDataFrame(rows, "customer_id long, article_id long, day string").select("customer_id", "article_id", F.to_date("day").alias("transaction_date"))
    monkeypatch.setattr(rankers, "PART", 20)
    fits = []
    fit = TwoTower.fit_parts
    monkeypatch.setattr(TwoTower, "fit_parts", lambda self, examples, *rest: fits.append((self, examples.count(), examples.rdd.getNumPartitions(), examples.filter("held").count())) or fit(self, examples, *rest))
    run = lambda: sorted(map(tuple, rankers.two_tower_candidates(tx, articles, tx.filter("customer_id < 40 OR customer_id = 200"), "2001-06-30", k=7, epochs=4, rate=0.3, width=8).collect()))
    got = run()
    model, n, parts, held = fits[0]
    assert (n, parts) == (90, 5) and 0 < held < 90
    assert len(model.losses) == 4 and model.losses[-1] < model.losses[0]
    assert run() == got and len(got) == 41 * 7
    rank = {}
    for customer, article, score, place in got:
        rank.setdefault(customer, []).append((place, article, score))
    for lines in rank.values():
        assert [p for p, *_ in sorted(lines)] == list(range(1, 8))
        assert [a for _, a, _ in sorted(lines)] == [a for *_, a in sorted((-round(s, 9), a) for _, a, s in lines)]
    # A customer of one article has its vector: articles with its tokens that are observed come first, by number.
    assert [a for _, a, _ in sorted(rank[200])][:2] == [3, 15] and all(a < 40 for lines in rank.values() for _, a, _ in lines)

"""Folds, frozen systems, external steps and the two-tower model on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import external, features
from larkspur.operators.rankers import TwoTower
from larkspur.plans import experiments
from larkspur.sources.relations import articles, transactions


def test_folds_never_see_later_snapshots(spark, data):
    tx, cat = transactions(spark, data).persist(), articles(spark, data)
    sources = {k: v for k, v in experiments.default_sources(cat, 2000, 1).items() if k in ("recent_pop", "repeat_purchase")}
    snaps = [experiments.snapshot(tx, cat, sources, day, days=60, customers=20).persist() for day in ("2000-01-31", "2000-06-30", "2000-12-31")]
    assert all(s.filter("label = 1").count() >= 0 and s.count() > 0 for s in snaps)
    columns = [x for x in features.feature_columns(list(sources)) if not x.startswith("rank_pct")]
    rows = experiments.run_folds(snaps, columns, {"family": "trees", "options": {"trees": 2, "depth": 2}}, first=2).collect()
    assert [r.fold for r in rows] == [2] and 0 <= rows[0].map_at_k <= 1


def test_frozen_before_holdout(spark):
    frozen = experiments.freeze({"family": "trees", "k": 50})
    one = spark.createDataFrame([(0.2,)], "m double")
    got = experiments.holdout_batches(frozen, [one, one.withColumn("m", F.lit(0.4))], lambda b: b).first()
    assert got.m == pytest.approx(0.3)
    with pytest.raises(ValueError, match="frozen"):
        experiments.holdout_batches({**frozen, "spec": {"k": 51}}, [one], lambda b: b)


def test_comparison_of_arms(spark):
    base = spark.createDataFrame([(1, 0.10), (2, 0.20)], "fold int, map_at_k double")
    arm = spark.createDataFrame([(1, 0.11), (2, 0.21)], "fold int, map_at_k double")
    summary, accepted = experiments.compare_arms(base, arm)
    assert summary.first().wins == 2 and accepted.first().accepted
    assert not experiments.compare_arms(base, base)[1].first().accepted


def test_two_towers_learn_a_small_catalogue():
    rng = np.random.default_rng(0)
    tokens = np.array([[i % 4, 4 + i % 3] for i in range(24)])
    groups = [[i for i in range(24) if i % 4 == g] for g in range(4)]
    examples = [(list(rng.choice(groups[g], 3)), [1 / 3] * 3, int(rng.choice(groups[g]))) for g in rng.integers(0, 4, 300)]
    model = TwoTower(width=8, epochs=25, negatives=16, rate=0.3).fit([(h, w) for h, w, _ in examples], [p for *_, p in examples], tokens)
    assert model.losses[-1] < model.losses[0]
    v = model.items(tokens)
    near = np.mean([(v[a] @ v[b]) for g in groups for a in g for b in g])
    far = np.mean([(v[a] @ v[b]) for a in groups[0] for b in groups[1]])
    assert near > far


def test_external_steps_are_checked_cached_and_limited():
    calls, now = [], [0.0]
    steps = external.ExternalSteps(lambda stage, payload: calls.append(stage) or ["b", "x", "b"])
    assert steps.rerank("q", ["a", "b", "c"]) == (["b", "a", "c"], 1)
    assert steps.rerank("q", ["a", "b", "c"])[0] == ["b", "a", "c"] and len(calls) == 1
    bad = external.ExternalSteps(lambda stage, payload: calls.append(stage) or "no list")
    assert bad.rerank("q", ["a"]) == (["a"], 0) and len(calls) == 3
    assert external.ExternalSettings.from_mapping({"enabled": "yes", "calls_per_minute": "9999"}) == external.ExternalSettings(True, 600, 2)


def test_call_budget_holds_in_any_window():
    now = [0.0]
    budget = external.CallBudget(2, 60, lambda: now[0])
    got = []
    for at in (0, 30, 59, 60, 89, 90, 119, 120):
        now[0] = at
        got.append(budget.spend())
    assert got == [True, True, False, True, False, True, False, True]


def test_answers_longest_unused_go():
    cache = external.AnswerCache(2)
    for k in "ab":
        cache.keep(k, k.upper())
    assert cache.look_up("a") == "A"
    cache.keep("c", "C")
    assert cache.look_up("b") is None and cache.look_up("a") == "A" and cache.look_up("c") == "C"
    assert external.inactive("off", 3) == {"active": False, "reason": "off", "candidates": 3} and external.inactive("off") == {"active": False, "reason": "off"}

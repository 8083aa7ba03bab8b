"""Every registered query of the library against its SQL; those without SQL must give rows."""

import pytest

from larkspur.plans import audits, candidates, evaluation, search
from larkspur.sources.relations import customers
from tests.compare import both, connect

PLANS = (audits, candidates, evaluation, search)
QUERIES = {n: q for p in PLANS for n, q in p.QUERIES.items()}
ORACLES = {n: q for p in PLANS for n, q in p.ORACLES.items()}
#: Small data may leave these without rows.
MAY_BE_EMPTY = {"cooccurrence_pairs", "cooccurrence_neighbors", "cooccurrence_candidates", "audit_dup_multiplicity"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, con, name):
    got, want = both(con, QUERIES[name](spark, data), ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, data, name):
    n = QUERIES[name](spark, data).count()
    assert n >= 0 if name in MAY_BE_EMPTY else n > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_live_or_stored_covers_every_customer(spark, monkeypatch):
    data = "/root/testdata/sf0.01"
    monkeypatch.setattr(search, "slates", lambda s, d: s.createDataFrame([(401, 7, 1), (402, 8, 1)], "customer_id long, article_id long, rank int"))
    got = {r.customer_id: r.origin for r in QUERIES["live_or_stored"](spark, data).collect()}
    want = {r.customer_id for r in customers(spark, data).select("customer_id").collect()}
    assert max(want) > 402 and got.keys() == want
    assert (got[401], got[402], got[max(want)]) == ("stored", "live", "none")

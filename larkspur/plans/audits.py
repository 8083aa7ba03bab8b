"""Registered audits, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import audit
from larkspur.operators.folds import before
from larkspur.plans.sql import CUTOFF, END, START, compose
from larkspur.sources.relations import CATEGORIES, articles, customers, transactions

CUSTOMER_FIELDS = ["club_member_status", "fashion_news_frequency"]
ARTICLE_FIELDS = ["prod_name", *CATEGORIES]


def _target(tx):
    return tx.filter(F.col("transaction_date").between(F.lit(START).cast("date"), F.lit(END).cast("date")))


QUERIES = {
    "audit_overview": lambda s, d: audit.overview({"transactions": (transactions(s, d), "customer_id", "article_id"), "customers": (customers(s, d), "customer_id", None), "articles": (articles(s, d), "article_id", None)}),
    "audit_txn_quality": lambda s, d: audit.transaction_quality(transactions(s, d)),
    "audit_catalog_keys": lambda s, d: audit.key_quality({"customers": (customers(s, d), "customer_id"), "articles": (articles(s, d), "article_id")}),
    "audit_missing_customer": lambda s, d: audit.missingness(customers(s, d), ["customer_id", *CUSTOMER_FIELDS, "acctbal"]),
    "audit_missing_article": lambda s, d: audit.missingness(articles(s, d), ["article_id", *ARTICLE_FIELDS]),
    "audit_profile_quality": lambda s, d: audit.profile_quality(customers(s, d)),
    "audit_category_domains": lambda s, d: audit.domains(customers(s, d), CUSTOMER_FIELDS),
    "audit_catalog_shape": lambda s, d: audit.shape(articles(s, d), list(CATEGORIES), "prod_name"),
    "audit_fk_coverage": lambda s, d: audit.key_coverage(transactions(s, d), {"customer_id": customers(s, d), "article_id": articles(s, d)}),
    "audit_sales_channels": lambda s, d: audit.shares(transactions(s, d), "sales_channel_id"),
    "audit_price_dist": lambda s, d: audit.price_distribution(transactions(s, d)),
    "audit_dup_summary": lambda s, d: audit.duplicate_summary(transactions(s, d)),
    "audit_dup_multiplicity": lambda s, d: audit.duplicate_multiplicity(transactions(s, d)),
    "audit_customer_activity": lambda s, d: audit.activity(transactions(s, d), "customer_id", "transaction_date"),
    "audit_article_popularity": lambda s, d: audit.concentration(transactions(s, d), "article_id"),
    "audit_daily_activity": lambda s, d: audit.activity(transactions(s, d), "transaction_date", "customer_id"),
    "audit_temporal_split": lambda s, d: audit.splits(transactions(s, d), CUTOFF, START, END),
    "audit_coldness": lambda s, d: audit.coldness(before(transactions(s, d), CUTOFF), _target(transactions(s, d))),
    "audit_target_dist": lambda s, d: audit.target_spread(_target(transactions(s, d))),
    "audit_busiest_days": lambda s, d: audit.busiest_days(transactions(s, d)),
    "audit_top_articles": lambda s, d: audit.top_articles(transactions(s, d), articles(s, d)),
    "article_text_audit": lambda s, d: audit.text_fields(articles(s, d), ["prod_name", "product_group_name"]),
    "article_text_examples": lambda s, d: audit.text_examples(articles(s, d), "prod_name"),
}


def _missing(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (CAST({c} AS VARCHAR) IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS n_missing, "
        f"coalesce(round(100.0::DOUBLE * count(*) FILTER (CAST({c} AS VARCHAR) IS NULL OR trim(CAST({c} AS VARCHAR)) = '') / nullif(count(*), 0), 6), 0) AS percent FROM {table}"
        for c in columns
    )


def _spread(c: str, quantiles: dict[str, float]) -> str:
    return f"min({c}) AS min_{c}, max({c}) AS max_{c}, round(avg({c}), 6) AS mean_{c}" + "".join(f", round(quantile_cont({c}::DOUBLE, {q}), 6) AS {n}_{c}" for n, q in quantiles.items())


_ACTIVITY = """SELECT count(*) AS n, {} , {} FROM (SELECT {}, count(*) AS purchases, count(DISTINCT {}) AS spread FROM tx GROUP BY ALL)"""
_P, _S = {"median": 0.5, "p90": 0.9, "p99": 0.99}, {"median": 0.5, "p99": 0.99}
_DUP = "SELECT count(*) AS times FROM tx GROUP BY transaction_date, customer_id, article_id, price, sales_channel_id HAVING count(*) > 1"
_T = f"transaction_date BETWEEN DATE '{START}' AND DATE '{END}'"


def _text(f: str) -> str:
    full = f"{f} IS NOT NULL AND trim({f}) <> ''"
    return (
        f"SELECT '{f}' AS field, count(*) FILTER ({full}) AS n_filled, count(*) FILTER (NOT ({full})) AS n_missing, round(avg(length({f})) FILTER ({full}), 6) AS mean_chars, "
        f"round(avg(len(string_split(trim({f}), ' '))) FILTER ({full}), 6) AS mean_words, count(DISTINCT {f}) FILTER ({full}) AS n_values FROM art"
    )


ORACLES = {k: compose(v) for k, v in {
    "audit_overview": "SELECT 'transactions' AS relation, count(*) AS n_rows, count(DISTINCT customer_id) AS n_keys, count(DISTINCT article_id) AS n_second_keys FROM tx UNION ALL SELECT 'customers', count(*), count(DISTINCT customer_id), 0 FROM cust UNION ALL SELECT 'articles', count(*), count(DISTINCT article_id), 0 FROM art",
    "audit_txn_quality": "SELECT min(transaction_date) AS first_day, max(transaction_date) AS last_day, sum((transaction_date IS NULL)::INT)::BIGINT AS bad_dates, sum((customer_id IS NULL)::INT)::BIGINT AS blank_customers, sum((article_id IS NULL)::INT)::BIGINT AS blank_articles, sum((price IS NULL)::INT)::BIGINT AS bad_prices, sum((price <= 0)::INT)::BIGINT AS free_prices, sum((sales_channel_id IS NULL)::INT)::BIGINT AS bad_channels, min(length(customer_id::VARCHAR))::INT AS min_customer_length, max(length(customer_id::VARCHAR))::INT AS max_customer_length, min(length(article_id::VARCHAR))::INT AS min_article_length, max(length(article_id::VARCHAR))::INT AS max_article_length FROM tx",
    "audit_catalog_keys": "SELECT 'customers' AS relation, count(*) AS n_rows, count(DISTINCT customer_id) AS n_keys, count(*) - count(customer_id) AS blank_keys FROM cust UNION ALL SELECT 'articles', count(*), count(DISTINCT article_id), count(*) - count(article_id) FROM art",
    "audit_missing_customer": _missing("cust", ["customer_id", *CUSTOMER_FIELDS, "acctbal"]),
    "audit_missing_article": _missing("art", ["article_id", *ARTICLE_FIELDS]),
    "audit_profile_quality": f"SELECT 0::BIGINT AS bad_values, {_spread('acctbal', {'p25': 0.25, 'median': 0.5, 'p75': 0.75})}, count(*) FILTER (acctbal < 0) AS n_negative, count(*) FILTER (acctbal > 9000) AS n_large, count(DISTINCT fashion_news_frequency) AS n_places FROM cust",
    "audit_category_domains": "SELECT field, value, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY field), 4) AS percent FROM (UNPIVOT (SELECT coalesce(club_member_status, '<NULL>') AS club_member_status, coalesce(fashion_news_frequency, '<NULL>') AS fashion_news_frequency FROM cust) ON club_member_status, fashion_news_frequency INTO NAME field VALUE value) GROUP BY field, value",
    "audit_catalog_shape": "SELECT " + ", ".join(f"count(DISTINCT {c}) AS n_{c}" for c in CATEGORIES) + ", count(*) FILTER (prod_name IS NULL OR trim(prod_name) = '') AS blank_prod_name FROM art",
    "audit_fk_coverage": "SELECT 'customer_id' AS key, count(DISTINCT customer_id) AS n_used, count(DISTINCT customer_id) FILTER (customer_id NOT IN (SELECT customer_id FROM cust)) AS n_missing FROM tx UNION ALL SELECT 'article_id', count(DISTINCT article_id), count(DISTINCT article_id) FILTER (article_id NOT IN (SELECT article_id FROM art)) FROM tx",
    "audit_sales_channels": "SELECT sales_channel_id, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM tx), 4) AS percent FROM tx GROUP BY sales_channel_id",
    "audit_price_dist": f"SELECT {_spread('price', {'p25': 0.25, 'median': 0.5, 'p75': 0.75, 'p99': 0.99})} FROM tx",
    "audit_dup_summary": f"SELECT count(*) AS n_groups, coalesce(sum(times), 0)::BIGINT AS n_rows, coalesce(sum(times) - count(*), 0)::BIGINT AS n_excess, coalesce(max(times), 0) AS largest FROM ({_DUP})",
    "audit_dup_multiplicity": f"SELECT times, count(*) AS n_groups, (times * count(*))::BIGINT AS n_rows FROM ({_DUP}) GROUP BY times ORDER BY times LIMIT 20",
    "audit_customer_activity": _ACTIVITY.format(_spread("purchases", _P), _spread("spread", _S), "customer_id", "transaction_date"),
    "audit_article_popularity": f"SELECT count(*) AS n, {_spread('purchases', _P)}, " + ", ".join(f"round(100.0::DOUBLE * sum(purchases) FILTER (r <= {t}) / sum(purchases), 4) AS top_{t}_percent" for t in (12, 100, 1000)) + " FROM (SELECT count(*) AS purchases, row_number() OVER (ORDER BY count(*) DESC, article_id) AS r FROM tx GROUP BY article_id)",
    "audit_daily_activity": _ACTIVITY.format(_spread("purchases", _P), _spread("spread", _S), "transaction_date", "customer_id"),
    "audit_temporal_split": f"SELECT if(transaction_date <= DATE '{CUTOFF}', 'training', if({_T}, 'validation', 'outside')) AS split, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, count(DISTINCT article_id) AS n_articles, min(transaction_date) AS first_day, max(transaction_date) AS last_day FROM tx GROUP BY 1",
    "audit_coldness": f"SELECT count(DISTINCT customer_id) AS n_customers, count(DISTINCT customer_id) FILTER (customer_id NOT IN (SELECT customer_id FROM hist)) AS cold_customers, count(DISTINCT article_id) AS n_articles, count(DISTINCT article_id) FILTER (article_id NOT IN (SELECT article_id FROM hist)) AS cold_articles, (SELECT count(*) FROM lab) AS n_pairs FROM tx WHERE {_T}",
    "audit_target_dist": f"SELECT count(*) AS n_customers, {_spread('relevant', _P)}, sum(n - relevant)::BIGINT AS n_repeats FROM (SELECT count(DISTINCT article_id) AS relevant, count(*) AS n FROM tx WHERE {_T} GROUP BY customer_id)",
    "audit_busiest_days": "SELECT transaction_date, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers FROM tx GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "audit_top_articles": "SELECT t.article_id, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, any_value(prod_name) AS prod_name FROM tx t JOIN art a USING (article_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "article_text_audit": _text("prod_name") + " UNION ALL " + _text("product_group_name"),
    "article_text_examples": "SELECT prod_name AS value, count(*) AS n FROM art WHERE trim(prod_name) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
}.items()}

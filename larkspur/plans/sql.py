"""SQL pieces for checking queries in another engine: named subqueries, put together as a query needs them."""

from __future__ import annotations

import re

CUTOFF, START, END = "2001-06-30", "2001-07-01", "2001-07-28"

PARTS: dict[str, str] = {
    "tx": """SELECT CAST(o.o_orderdate AS DATE) AS transaction_date, o.o_custkey AS customer_id, l.l_partkey AS article_id, l.l_extendedprice AS price,
        CASE l.l_linestatus WHEN 'O' THEN 2 ELSE 1 END AS sales_channel_id FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "art": """SELECT p_partkey AS article_id, p_name AS prod_name, coalesce(split_part(p_name, ' ', 2), '') AS product_type_name, p_type AS product_group_name,
        split_part(p_name, ' ', 1) AS colour_group_name, p_brand AS department_name, 'Section ' || CAST(CAST(ceil(p_size / 10.0) AS BIGINT) AS VARCHAR) AS section_name,
        p_brand || '/' || p_type AS garment_group_name FROM part""",
    "cust": """SELECT c_custkey AS customer_id, c_mktsegment AS club_member_status, n_name AS fashion_news_frequency, c_acctbal AS acctbal
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "hist": f"SELECT * FROM tx WHERE transaction_date <= DATE '{CUTOFF}'",
    "lab": f"SELECT DISTINCT customer_id, article_id FROM tx WHERE transaction_date BETWEEN DATE '{START}' AND DATE '{END}'",
    "who": "SELECT DISTINCT customer_id FROM lab",
    "owned": "SELECT DISTINCT customer_id, article_id FROM hist",
}


def part(name: str, body: str) -> str:
    """Add a named subquery; returns its name."""
    PARTS[name] = body
    return name


def compose(body: str) -> str:
    """The query with every named subquery that it or they use, in order of need."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in PARTS:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(PARTS[name])
                if name not in order:
                    order.append(name)

    need(body)
    heads = ", ".join(f"{n} AS ({PARTS[n]})" for n in order)
    return f"WITH {heads} {body}" if heads else body

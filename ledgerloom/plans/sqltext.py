"""SQL fragments the SQL twins share.

The twins always read the whole seven-table view, so agreeing with them also shows
that leaving out unused joins does not change a result.
"""

from __future__ import annotations

from collections.abc import Mapping

from ledgerloom.plans.labels import LABELS

SALES = """
lines AS (
  SELECT *, CAST(l_quantity AS BIGINT) AS q,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS line_cents,
    CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DECIMAL(5,2)) AS pct
  FROM lineitem),
priced AS (
  SELECT *, CAST(((2 * line_cents + q) // NULLIF(2 * q, 0)) * 0.01 AS DECIMAL(12,2)) AS price FROM lines),
sales AS (
  SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS transaction_id,
    CAST(o_orderdate AS DATE) AS date, p_brand AS product, q AS quantity, price AS unit_price,
    CAST(o_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
    concat(lower(replace(c_name, '#', '')), '@example.com') AS customer_email,
    c_mktsegment AS customer_segment, r_name AS region, o_orderpriority AS sales_channel,
    s_name AS salesperson,
    CASE WHEN s_acctbal >= 8000 THEN 'top_performer' WHEN s_acctbal >= 6000 THEN 'high_performer'
         WHEN s_acctbal >= 1000 THEN 'average_performer' ELSE 'low_performer' END AS salesperson_tier,
    pct AS discount_percent,
    CAST(round(CAST(q AS DECIMAL(10,0)) * price * (100 - pct) * 0.01, 2) AS DECIMAL(14,2)) AS total_amount
  FROM priced
  LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""


def with_sales(body: str, *ctes: str) -> str:
    """A query over ``sales`` and further CTEs."""
    return "WITH " + ", ".join([SALES.strip(), *(cte.strip() for cte in ctes)]) + "\n" + body.strip()


def mean(column: str) -> str:
    return f"CAST(SUM({column}) AS DOUBLE) / COUNT({column})"


def total(column: str) -> str:
    return f"CAST(SUM({column}) AS DOUBLE)"


def total_or_zero(column: str) -> str:
    return f"COALESCE(CAST(SUM({column}) AS DOUBLE), 0.0)"


def whole(expression: str) -> str:
    """Integer result as BIGINT."""
    return f"CAST({expression} AS BIGINT)"


def rounded_mean(column: str) -> str:
    """Half-even mean to two places, on whole cents, for amounts that are not negative."""
    s, n = f"SUM(CAST({column} * 100 AS BIGINT))", f"COUNT({column})"
    up = f"2 * ({s} % {n}) > {n} OR (2 * ({s} % {n}) = {n} AND ({s} // {n}) % 2 = 1)"
    return f"CAST({s} // {n} + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / 100.0"


def choose(table: Mapping[str, object], key: str, other: str) -> str:
    """CASE from a label table; values are SQL text."""
    branches = " ".join(f"WHEN '{label}' THEN {value}" for label, value in table.items())
    return f"CASE {key} {branches} ELSE {other} END"


def quoted(labels) -> str:
    return ", ".join(f"'{label}'" for label in labels)


def translated_sales() -> str:
    """CTE ``translated``: sales with the labels the rules know."""
    columns = ", ".join(
        choose({k: f"'{v}'" for k, v in labels.items()}, name, name) + f" AS {name}"
        for name, labels in LABELS.items()
    )
    return f"translated AS (SELECT * REPLACE ({columns}) FROM sales)"


DOCUMENTED = """transaction_id, date, product, quantity, CAST(unit_price AS DOUBLE) AS unit_price, customer_id,
  customer_name, customer_email, customer_segment, region, sales_channel, salesperson, salesperson_tier,
  CAST(discount_percent AS DOUBLE) AS discount_percent, CAST(total_amount AS DOUBLE) AS total_amount"""

"""The pricing, discount and assignment rules over the translated sales."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators import additive, rules
from ledgerloom.operators import rulebook as book
from ledgerloom.plans import notebook
from ledgerloom.plans.labels import LABELS
from ledgerloom.plans.query import Query, on_sales
from ledgerloom.plans.sqltext import choose, quoted, translated_sales, with_sales
from ledgerloom.sources import batches, tables
from ledgerloom.sources.schema import FOLDER_COLUMNS
from ledgerloom.sources.scratch import fresh_path
from ledgerloom.sources.star import customers, sales_view, salespeople
from ledgerloom.sources.statistics import file_summary

ACCOUNTS = 7
REFERENCE_DAY = "2000-12-31"
CUT_DAY = "2000-01-01"


def rule(
    name: str, operator: Callable[[DataFrame], DataFrame], keep: str, sql: str, columns: str
) -> Query:
    """A row rule: its inputs and results per transaction, decimals as double."""

    def apply(sales: DataFrame) -> DataFrame:
        result = operator(sales).select(*keep.split())
        return result.select(
            *[
                F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
                for c, t in result.dtypes
            ]
        )

    return on_sales(name, apply, with_sales(sql, translated_sales()), columns, labels=LABELS)


def season_sql(product: str = "product") -> str:
    base = choose({n: f"CAST({f} AS DECIMAL(4,2))" for n, f in book.SEASONAL_FACTORS.items()}, product, "1.00")
    season = " ".join(
        f"WHEN month(date) IN ({', '.join(map(str, months))}) THEN {value}"
        for months, value in book.SEASONS.items()
    )
    return f"(({base}) * CASE {season} ELSE 1.0 END)"


def region_sql(product: str = "product") -> str:
    strength = choose({k: f"CAST({v} AS DECIMAL(3,2))" for k, v in book.REGION_STRENGTH.items()}, "region", "1.00")
    adoption = choose({k: f"CAST({v} AS DECIMAL(3,2))" for k, v in book.REGION_ADOPTION.items()}, "region", "1.00")
    return (
        f"(CASE WHEN {product} IN ({quoted(book.TECHNOLOGY_PRODUCTS)}) "
        f"THEN (({strength}) + ({adoption})) * 0.5 ELSE ({strength}) * 1.0 END)"
    )


SEGMENT_SQL = "(" + choose(
    {k: f"CAST({v} AS DECIMAL(3,1))" for k, v in book.SEGMENT_MULTIPLIERS.items()}, "customer_segment", "1.0"
) + ")"


def bound_sql(end: int, quantity: str) -> str:
    base = choose(
        {k: str(v[end]) for k, v in book.CHANNEL_DISCOUNTS.items()},
        "sales_channel",
        str(book.OTHER_CHANNEL_DISCOUNT[end]),
    )
    added = " ".join(
        f"WHEN {quantity} >= {least} THEN {ends[end]}" for least, (_, ends) in book.VOLUME_TIERS.items()
    )
    lowest = book.VOLUME_TIERS[min(book.VOLUME_TIERS)][1][end]
    return f"({base} + CASE {added} ELSE {lowest} END)"


def account_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Account of every customer, in the order of the numeric customer key."""
    assigned = rules.account_assignment(customers(spark, folder), ACCOUNTS, "customer_key")
    return assigned.select(F.col("customer_key").cast("string").alias("customer_id"), "account")


def account_sales_frame(spark: SparkSession, folder: str) -> DataFrame:
    sales = sales_view(spark, folder, ("customer_id", "total_amount"))
    return rules.account_sales(sales, account_frame(spark, folder))


ACCOUNTS_CTE = f"""
accounts AS (
  SELECT customer_id, CAST(least((place - 1) // NULLIF(n // {ACCOUNTS}, 0), {ACCOUNTS - 1}) AS INTEGER) AS account
  FROM (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, ROW_NUMBER() OVER (ORDER BY c_custkey) AS place,
      COUNT(*) OVER () AS n FROM customer))"""


def performer_frame(spark: SparkSession, folder: str) -> DataFrame:
    return rules.performer_label(salespeople(spark, folder))


def written_months_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Write the sales by month to the shared folder, read them back, and total them on the folder columns."""
    path = fresh_path(spark, "written-months")
    tables.write_sales(sales_view(spark, folder, exact=False), path)
    return _months(tables.read_sales(spark, path))


def appended_months_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Append the sales in batches by their last year, one of them twice, and total the stored months."""
    path = _appended(spark, folder)
    sales = batches.read_batches(spark, path)
    return _months(sales)


def _appended(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "appended")
    sales = sales_view(spark, folder, exact=False)
    early = F.coalesce(F.col("date") < CUT_DAY, F.lit(True))
    batches.append_batch(sales.where(early), path, "early")
    batches.append_batch(sales.where(~early), path, "late")
    batches.append_batch(sales.where(early), path, "early")
    return path


def from_appended_parts(operator) -> Callable[[SparkSession, str], DataFrame]:
    """An analysis of the parts that the appended batches keep."""
    return lambda spark, folder: operator(batches.read_parts(spark, _appended(spark, folder)))


def file_summary_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Write the sales and take their number and dates from the files' statistics."""
    path = fresh_path(spark, "summed-up")
    tables.write_sales(sales_view(spark, folder, ("transaction_id", "date")), path)
    return file_summary(spark, path)


def _months(sales: DataFrame) -> DataFrame:
    year, month = FOLDER_COLUMNS
    return (
        sales.groupBy(F.col(year).alias("year"), F.col(month).alias("month"))
        .agg(F.count("*").alias("transaction_count"), F.sum("total_amount").cast("double").alias("total_sales"))
    )


MONTHS_SQL = with_sales(
    """
SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  COUNT(*) AS transaction_count, CAST(SUM(total_amount) AS DOUBLE) AS total_sales
FROM sales GROUP BY 1, 2"""
)

ADDITIVE = """region_sales region_metrics region_channel monthly_region_sales product_performance product_monthly
product_profitability product_region""".split()
WHOLE_TABLE_SQL = {query.name: query.sql for query in notebook.QUERIES}

QUERIES: list[Query] = [
    rule(
        "net_amount",
        rules.net_amount,
        "transaction_id quantity unit_price discount_percent subtotal discount_amount net_amount total_matches",
        """
SELECT transaction_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
  CAST(discount_percent AS DOUBLE) AS discount_percent, CAST(quantity * unit_price AS DOUBLE) AS subtotal,
  CAST(quantity * unit_price * discount_percent * 0.01 AS DOUBLE) AS discount_amount,
  CAST(net AS DOUBLE) AS net_amount, net = total_amount AS total_matches
FROM (SELECT *, CAST((quantity * CAST(unit_price * 100 AS BIGINT) * (100 - CAST(discount_percent AS BIGINT)) + 50) // 100
  AS DECIMAL(14,0)) * 0.01 AS net FROM translated)""",
        "transaction_id quantity unit_price discount_percent total_amount",
    ),
    rule(
        "seasonal_factor",
        rules.seasonal_factor,
        "transaction_id product date seasonal_factor",
        f"SELECT transaction_id, product, date, CAST({season_sql()} AS DOUBLE) AS seasonal_factor FROM translated",
        "transaction_id product date",
    ),
    rule(
        "regional_factor",
        rules.regional_factor,
        "transaction_id product region regional_factor",
        f"SELECT transaction_id, product, region, CAST({region_sql()} AS DOUBLE) AS regional_factor FROM translated",
        "transaction_id product region",
    ),
    rule(
        "segment_factor",
        rules.segment_factor,
        "transaction_id customer_segment segment_factor segment_price",
        f"""
SELECT transaction_id, customer_segment, CAST({SEGMENT_SQL} AS DOUBLE) AS segment_factor,
  CAST(round(unit_price * {SEGMENT_SQL}, 2) AS DOUBLE) AS segment_price FROM translated""",
        "transaction_id customer_segment unit_price",
    ),
    rule(
        "adjusted_price",
        rules.adjusted_price,
        "transaction_id unit_price adjusted_price",
        f"""
SELECT transaction_id, CAST(unit_price AS DOUBLE) AS unit_price,
  CAST(round(unit_price * {season_sql()} * {region_sql()} * {SEGMENT_SQL}, 2) AS DOUBLE) AS adjusted_price
FROM translated""",
        "transaction_id unit_price product date region customer_segment",
    ),
    rule(
        "discount_bounds",
        rules.discount_bounds,
        "transaction_id sales_channel quantity discount_percent min_pct max_pct volume_tier in_bounds",
        f"""
SELECT transaction_id, sales_channel, quantity, CAST(discount_percent AS DOUBLE) AS discount_percent,
  CAST({bound_sql(0, 'quantity')} AS DOUBLE) AS min_pct, CAST({bound_sql(1, 'quantity')} AS DOUBLE) AS max_pct,
  CASE WHEN quantity >= 5 THEN 'bulk' WHEN quantity >= 3 THEN 'multi' ELSE 'single' END AS volume_tier,
  discount_percent = 0 OR discount_percent BETWEEN {bound_sql(0, 'quantity')} AND {bound_sql(1, 'quantity')}
    AS in_bounds
FROM translated""",
        "transaction_id sales_channel quantity discount_percent",
    ),
    rule(
        "tier_adjusted_discount",
        rules.tier_adjusted_discount,
        "transaction_id salesperson_tier discount_percent adjusted_discount",
        """
SELECT transaction_id, salesperson_tier, CAST(discount_percent AS DOUBLE) AS discount_percent,
  CAST(round(discount_percent * CASE WHEN salesperson_tier IN ('top_performer', 'high_performer') THEN 0.8
    WHEN salesperson_tier = 'low_performer' THEN 1.3 ELSE 1.0 END, 2) AS DOUBLE) AS adjusted_discount
FROM translated""",
        "transaction_id salesperson_tier discount_percent",
    ),
    Query(
        "account_assignment",
        account_frame,
        f"WITH {ACCOUNTS_CTE.strip()} SELECT customer_id, account FROM accounts",
    ),
    Query(
        "account_sales",
        account_sales_frame,
        with_sales(
            """
SELECT account, CAST(SUM(total_amount) AS DOUBLE) AS total_sales, COUNT(*) AS transaction_count,
  COUNT(DISTINCT customer_id) AS active_customers
FROM sales JOIN accounts USING (customer_id) GROUP BY account""",
            ACCOUNTS_CTE,
        ),
    ),
    Query(
        "performer_label",
        performer_frame,
        """
SELECT salesperson, salesperson_tier, salesperson || CASE salesperson_tier WHEN 'top_performer' THEN ' (Top)'
  WHEN 'high_performer' THEN ' (High)' WHEN 'low_performer' THEN ' (Low)' ELSE '' END AS performer_label
FROM (SELECT s_name AS salesperson, CASE WHEN s_acctbal >= 8000 THEN 'top_performer'
  WHEN s_acctbal >= 6000 THEN 'high_performer' WHEN s_acctbal >= 1000 THEN 'average_performer'
  ELSE 'low_performer' END AS salesperson_tier FROM supplier)""".strip(),
    ),
    rule(
        "history_window",
        lambda sales: rules.history_window(sales, as_of=REFERENCE_DAY),
        "transaction_id date window_start in_window",
        f"""
SELECT transaction_id, date, DATE '{REFERENCE_DAY}' - {book.HISTORY_DAYS} AS window_start,
  date BETWEEN DATE '{REFERENCE_DAY}' - {book.HISTORY_DAYS} AND DATE '{REFERENCE_DAY}' AS in_window
FROM translated""",
        "transaction_id date",
    ),
    Query("written_months", written_months_frame, MONTHS_SQL),
    Query("appended_months", appended_months_frame, MONTHS_SQL),
    Query(
        "file_summary",
        file_summary_frame,
        with_sales("SELECT COUNT(*) AS n, MIN(date) AS min_date, MAX(date) AS max_date FROM sales"),
    ),
    *[
        Query(f"appended_{name}", from_appended_parts(getattr(additive, name)), WHOLE_TABLE_SQL[name])
        for name in ADDITIVE
    ],
]

"""Filter choices and analyses of the filtered sales.

Each filtered analysis is registered on the whole table, under all three filters, under
each filter alone and under a filter nothing passes; so are all panels together, from one
read of the sales.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import dashboard, filters, headline, products, regions
from ledgerloom.plans.notebook import PRODUCT_TOTALS, REGIONS, matrix_cells
from ledgerloom.plans.query import Query, on_sales
from ledgerloom.plans.sqltext import (
    DOCUMENTED,
    mean,
    quoted,
    rounded_mean,
    total_or_zero,
    whole,
    with_sales,
)
from ledgerloom.sources import star
from ledgerloom.sources.schema import SALES_COLUMNS, documented
from ledgerloom.sources.scratch import fresh_path

DATES = ("1997-01-01", "1999-12-31")
SOME_REGIONS = ("ASIA", "EUROPE", "MIDDLE EAST")
SOME_PRODUCTS = tuple(f"Brand#{n}" for n in range(1, 19))
NOWHERE = ("ATLANTIS",)

ON_DATES = f"date BETWEEN DATE '{DATES[0]}' AND DATE '{DATES[1]}'"
IN_REGIONS = f"region IN ({quoted(SOME_REGIONS)})"
AMONG_PRODUCTS = f"product IN ({quoted(SOME_PRODUCTS)})"

# suffix -> filter arguments, the same as a SQL predicate, the columns it reads
UNFILTERED = {"": ({}, "TRUE", "")}
ALL_FILTERS = {
    "_filtered": (
        {"date_range": DATES, "regions": SOME_REGIONS, "products": SOME_PRODUCTS},
        f"{ON_DATES} AND {IN_REGIONS} AND {AMONG_PRODUCTS}",
        "date region product",
    )
}
EACH_FILTER = {
    "_by_date": ({"date_range": DATES}, ON_DATES, "date"),
    "_by_region": ({"regions": SOME_REGIONS}, IN_REGIONS, "region"),
    "_by_product": ({"products": SOME_PRODUCTS}, AMONG_PRODUCTS, "product"),
    "_none_match": ({"regions": NOWHERE}, f"region IN ({quoted(NOWHERE)})", "region"),
}
EVERY = UNFILTERED | ALL_FILTERS | EACH_FILTER


def variants(
    name: str,
    operator: Callable[..., DataFrame],
    sql: str | Callable[[dict], str],
    columns: str,
    ctes: str = "",
    exact: bool = True,
) -> list[Query]:
    """One query per filter case; ``sql``, which may depend on the filter, reads the CTE
    ``chosen``."""
    made = []
    for suffix, (arguments, predicate, filter_columns) in EVERY.items():
        body = sql if isinstance(sql, str) else sql(arguments)
        chosen = f"chosen AS (SELECT * FROM sales WHERE {predicate})"
        made.append(
            on_sales(
                name + suffix,
                lambda sales, arguments=arguments: operator(sales, **arguments),
                with_sales(body, *([chosen, ctes] if ctes else [chosen])),
                f"{columns} {filter_columns}",
                exact,
            )
        )
    return made


def shown(arguments: dict):
    """Columns of the matrix: the regions that the filter lets through."""
    return arguments.get("regions", REGIONS)


KPI = f"""
SELECT {total_or_zero('total_amount')} AS total_sales, COUNT(*) AS total_transactions,
  {mean('total_amount')} AS avg_transaction, COUNT(DISTINCT customer_id) AS unique_customers
FROM chosen"""

BEST = """best AS (SELECT product FROM chosen WHERE product IS NOT NULL GROUP BY product
  ORDER BY SUM(total_amount) DESC NULLS LAST, product LIMIT 15)"""

# name, operator, SQL, columns, further CTEs
PANELS = [
    ("kpi_values", headline.kpi_values, KPI, "total_amount customer_id"),
    (
        "kpi_text",
        headline.kpi_text,
        f"""
SELECT CASE WHEN total_transactions = 0 THEN '$0' ELSE '$' || format('{{:,.0f}}', total_sales) END AS total_sales,
  format('{{:,}}', total_transactions) AS total_transactions,
  CASE WHEN total_transactions = 0 THEN '$0'
       ELSE '$' || COALESCE(format('{{:.2f}}', avg_transaction), 'nan') END AS avg_transaction,
  format('{{:,}}', unique_customers) AS unique_customers
FROM ({KPI})""",
        "total_amount customer_id",
    ),
    (
        "dash_region_bar",
        regions.region_bar,
        f"""
SELECT region, {total_or_zero('total_amount')} AS total_amount, COUNT(customer_id) AS transaction_count
FROM chosen WHERE region IS NOT NULL GROUP BY region""",
        "region total_amount customer_id",
    ),
    (
        "dash_region_scatter",
        regions.region_scatter,
        f"""
SELECT *, total_sales / NULLIF(unique_customers, 0) AS sales_per_customer
FROM (SELECT region, {total_or_zero('total_amount')} AS total_sales, {mean('total_amount')} AS avg_transaction,
    COUNT(DISTINCT customer_id) AS unique_customers, {whole('COALESCE(SUM(quantity), 0)')} AS total_quantity
  FROM chosen WHERE region IS NOT NULL GROUP BY region)""",
        "region total_amount customer_id quantity",
    ),
    (
        "dash_region_timeline",
        regions.region_timeline,
        f"""
SELECT CAST(date_trunc('month', date) AS DATE) AS date, region, {total_or_zero('total_amount')} AS total_amount
FROM chosen WHERE region IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2""",
        "region date total_amount",
    ),
    (
        "dash_top_products",
        products.product_bar,
        f"""
SELECT product, {total_or_zero('total_amount')} AS total_amount
FROM chosen WHERE product IS NOT NULL GROUP BY product ORDER BY total_amount DESC, product LIMIT 10""",
        "product total_amount",
    ),
    (
        "dash_product_profitability",
        products.product_profitability_scatter,
        f"""
SELECT *, total_amount / NULLIF(quantity, 0) AS revenue_per_unit
FROM (SELECT product, {total_or_zero('total_amount')} AS total_amount,
    {whole('COALESCE(SUM(quantity), 0)')} AS quantity, {mean('unit_price')} AS unit_price,
    {mean('discount_percent')} AS discount_percent
  FROM chosen WHERE product IS NOT NULL GROUP BY product)
ORDER BY revenue_per_unit DESC NULLS LAST, product LIMIT 15""",
        "product total_amount quantity unit_price discount_percent",
    ),
    (
        "dash_product_region_matrix",
        lambda sales, **arguments: products.product_region_matrix(sales, 15, shown(arguments), **arguments),
        lambda arguments: matrix_cells("chosen SEMI JOIN best USING (product)", shown(arguments)),
        "product region total_amount",
        BEST,
    ),
    (
        "dash_region_table",
        regions.region_table,
        f"""
SELECT region, {total_or_zero('total_amount')} AS total_sales, {rounded_mean('total_amount')} AS avg_transaction,
  {whole('COALESCE(SUM(quantity), 0)')} AS total_quantity, COUNT(customer_id) AS total_transactions,
  COUNT(DISTINCT customer_id) AS unique_customers, {rounded_mean('discount_percent')} AS avg_discount
FROM chosen WHERE region IS NOT NULL GROUP BY region""",
        "region total_amount quantity customer_id discount_percent",
    ),
    (
        "dash_product_table",
        products.product_table,
        f"""
SELECT product, {total_or_zero('total_amount')} AS total_sales,
  {whole('COALESCE(SUM(quantity), 0)')} AS total_quantity, {rounded_mean('unit_price')} AS avg_unit_price,
  {rounded_mean('discount_percent')} AS avg_discount, COUNT(customer_id) AS total_transactions
FROM chosen WHERE product IS NOT NULL GROUP BY product ORDER BY total_sales DESC, product LIMIT 20""",
        "product total_amount quantity unit_price discount_percent customer_id",
    ),
]
LABELS = {"date": "DATE", "region": "VARCHAR", "product": "VARCHAR"}
# label columns and measures of each panel; null: the regions shown
PANEL_COLUMNS = {
    "kpi_values": ("", "total_sales total_transactions avg_transaction unique_customers"),
    "kpi_text": ("", "total_sales total_transactions avg_transaction unique_customers"),
    "dash_region_bar": ("region", "total_amount transaction_count"),
    "dash_region_scatter": ("region", "total_sales avg_transaction unique_customers total_quantity sales_per_customer"),
    "dash_region_timeline": ("date region", "total_amount"),
    "dash_top_products": ("product", "total_amount"),
    "dash_product_profitability": ("product", "total_amount quantity unit_price discount_percent revenue_per_unit"),
    "dash_product_region_matrix": ("product", None),
    "dash_region_table": ("region", "total_sales avg_transaction total_quantity total_transactions unique_customers avg_discount"),
    "dash_product_table": ("product", "total_sales total_quantity avg_unit_price avg_discount total_transactions"),
}


def panels_sql(arguments: dict) -> str:
    """The results of all panels, one row per measure."""
    made = []
    for name, _, sql, *_ in PANELS:
        labels, measures = PANEL_COLUMNS[name]
        measures = shown(arguments) if measures is None else measures.split()
        value = lambda m: f"CAST(\"{m}\" AS DOUBLE), 'text': NULL" if name != "kpi_text" else f"NULL, 'text': \"{m}\""
        cells = ", ".join(f"{{'measure': '{m}', 'value': {value(m)}}}" for m in measures)
        known = ", ".join(f"{c if c in labels.split() else f'CAST(NULL AS {kind})'} AS {c}" for c, kind in LABELS.items())
        body = sql if isinstance(sql, str) else sql(arguments)
        made.append(
            f"SELECT '{name.removeprefix('dash_')}' AS panel, {known}, cell.measure, CAST(cell.value AS DOUBLE) AS value, "
            f"CAST(cell.text AS VARCHAR) AS text FROM (SELECT *, unnest([{cells}]) AS cell FROM ({body}))"
        )
    return "\nUNION ALL\n".join(made)


def all_panels(sales: DataFrame, **arguments) -> DataFrame:
    return dashboard.panel_values(dashboard.dashboard(sales, **arguments), shown(arguments))


BUCKETS = 8


def kpi_on_bucketed_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Headline figures of a date range from line items and orders bucketed by order."""
    database = f"bucketed_{zlib.crc32(folder.encode()):08x}_{spark.sparkContext.applicationId.replace('-', '_')}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{fresh_path(spark, database)}'")
    star.write_bucketed(spark, folder, database, BUCKETS)
    sales = star.sales_view(spark, folder, ("total_amount", "customer_id", "date"), read=star.from_bucketed(database))
    return headline.kpi_values(sales, date_range=DATES)


QUERIES: list[Query] = [
    *variants(
        "filtered_sales",
        filters.filtered_sales,
        f"SELECT {DOCUMENTED} FROM chosen",
        " ".join(SALES_COLUMNS),
        exact=False,
    ),
    on_sales(
        "filter_regions",
        filters.distinct_regions,
        with_sales("SELECT DISTINCT region FROM sales"),
        "region",
    ),
    on_sales(
        "filter_top_products",
        filters.top_product_names,
        with_sales("SELECT product FROM ranked WHERE place <= 20", PRODUCT_TOTALS),
        "product total_amount",
    ),
    on_sales(
        "filter_date_range",
        filters.date_bounds,
        with_sales("SELECT MIN(date) AS min_date, MAX(date) AS max_date FROM sales"),
        "date",
    ),
    on_sales(
        "top_product_rows",
        lambda sales: documented(filters.top_product_rows(sales)),
        with_sales(
            f"SELECT {DOCUMENTED} FROM sales WHERE product IN (SELECT product FROM ranked WHERE place <= 5)",
            PRODUCT_TOTALS,
        ),
    ),
    *[query for panel in PANELS for query in variants(*panel)],
    Query("kpi_values_bucketed", kpi_on_bucketed_tables, with_sales(KPI, f"chosen AS (SELECT * FROM sales WHERE {ON_DATES})")),
    *variants("dashboard_panels", all_panels, panels_sql, " ".join(dashboard.NEEDED), BEST),
]

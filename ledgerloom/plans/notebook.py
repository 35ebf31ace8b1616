"""Whole-table analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators import products, regions
from ledgerloom.operators.filters import filtered_sales
from ledgerloom.plans.query import Query, on_products, on_sales
from ledgerloom.plans.sqltext import DOCUMENTED, mean, rounded_mean, total, whole, with_sales
from ledgerloom.sources import tables
from ledgerloom.sources.schema import SALES_COLUMNS, documented
from ledgerloom.sources.star import sales_view

# All months of the data, 1995-01 to 2001-08; in some of them some region has no sale.
PIVOT_MONTHS = [f"{year}-{month:02d}" for year in range(1995, 2002) for month in range(1, 13)][:80]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

REGION_MONTHS = """
months AS (
  SELECT region, CAST(date_trunc('month', date) AS DATE) AS date, SUM(total_amount) AS total,
    COUNT(*) AS n, CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount) AS month_mean
  FROM sales GROUP BY 1, 2)"""

PRODUCT_TOTALS = """
totals AS (SELECT product, SUM(total_amount) AS total FROM sales GROUP BY product),
ranked AS (
  SELECT product, total, ROW_NUMBER() OVER (ORDER BY total DESC NULLS LAST, product ASC NULLS LAST) AS place,
    COUNT(*) OVER () AS n FROM totals)"""

PERFORMANCE = f"""
  SELECT product, {total('total_amount')} AS total_sales, {whole('SUM(quantity)')} AS total_quantity,
    {mean('unit_price')} AS avg_price, COUNT(*) AS transaction_count,
    {mean('discount_percent')} AS avg_discount,
    CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS revenue_per_transaction
  FROM sales GROUP BY product"""

PROFITABILITY = f"""
  SELECT *, total_sales / NULLIF(total_quantity, 0) AS revenue_per_unit,
    avg_unit_price * (avg_discount / 100) AS discount_impact
  FROM (SELECT product, {total('total_amount')} AS total_sales, {mean('unit_price')} AS avg_unit_price,
      {mean('discount_percent')} AS avg_discount, {whole('SUM(quantity)')} AS total_quantity
    FROM sales GROUP BY product)"""


def picked_month(direction: str) -> str:
    return with_sales(
        f"""
SELECT region, strftime(date, '%Y-%m') AS year_month, CAST(total AS DOUBLE) AS total_sales
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY total {direction}, date) AS place
      FROM months WHERE region IS NOT NULL AND total IS NOT NULL)
WHERE place = 1""",
        REGION_MONTHS,
    )


def matrix_cells(rows: str, shown=REGIONS) -> str:
    cells = ", ".join(
        f"COALESCE(CAST(SUM(total_amount) FILTER (WHERE region = '{name}') AS DOUBLE), 0.0) AS \"{name}\""
        for name in shown
    )
    return f"""SELECT product, {cells} FROM {rows} WHERE product IS NOT NULL
GROUP BY product HAVING COUNT(region) > 0"""


PREVIEW_ORDER = ("transaction_id", "date", "product", "total_amount")


def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    """First five sales by transaction id.  The ids are found on the line items alone;
    the dimensions are then joined to the rows with those ids, not to every sale."""
    ids = tables.preview(sales_view(spark, folder, ["transaction_id"]), 5, ["transaction_id"])
    rows = sales_view(spark, folder, exact=False).join(ids, "transaction_id", "left_semi")
    return tables.preview(rows, 5, PREVIEW_ORDER)


VIEW = "ledgerloom_sales"


def listed_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and revenue of the sales registered under a name, found in the list of tables."""
    sales_view(spark, folder, ["total_amount"]).createOrReplaceTempView(VIEW)
    found = [name for name in tables.list_tables(spark) if name == VIEW]
    sales = tables.sales_table(spark, found[0])
    return sales.agg(F.count("*").alias("n"), F.sum("total_amount").cast("double").alias("total_sales")).select(
        F.lit(found[0]).alias("table_name"), "n", "total_sales"
    )


def client_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first five sales, fetched and made into a table again."""
    return documented(tables.rows_to_sales(spark, (r.asDict() for r in first_rows(spark, folder).collect())))


def appended_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales by region of two disjoint region choices, appended: the same as of the whole."""
    sales = sales_view(spark, folder, ["region", "total_amount"])
    some = REGIONS[:2]
    rest = sales.where(~F.col("region").isin(*some) | F.col("region").isNull())
    return regions.region_sales(tables.append_sales(filtered_sales(sales, regions=some), rest))


REGION_SALES = f"""
SELECT region, {total('total_amount')} AS total_sales, {mean('total_amount')} AS avg_sales,
  COUNT(*) AS transaction_count, {mean('total_amount')} AS avg_transaction_value
FROM sales GROUP BY region"""
FIRST_ROWS = with_sales(
    f"SELECT {DOCUMENTED} FROM sales ORDER BY {', '.join('sales.' + c for c in PREVIEW_ORDER)} LIMIT 5"
)

QUERIES: list[Query] = [
    Query(
        "listed_tables",
        listed_tables,
        with_sales(f"SELECT '{VIEW}' AS table_name, COUNT(*) AS n, {total('total_amount')} AS total_sales FROM sales"),
    ),
    Query("client_rows", client_rows, FIRST_ROWS),
    Query("appended_sales", appended_sales, with_sales(REGION_SALES)),
    on_sales(
        "sales_row_count", tables.row_count, with_sales("SELECT COUNT(*) AS n FROM sales"), "transaction_id"
    ),
    on_sales(
        "sales_profile",
        lambda sales: tables.profile(sales, SALES_COLUMNS),
        with_sales(
            f"""
SELECT COUNT(*) AS n_rows, {len(SALES_COLUMNS)} AS n_columns, '{",".join(SALES_COLUMNS)}' AS column_names
FROM sales"""
        ),
        "transaction_id",
    ),
    Query(
        "sales_preview",
        first_rows,
        FIRST_ROWS,
    ),
    on_sales(
        "region_sales",
        regions.region_sales,
        with_sales(REGION_SALES),
        "region total_amount",
    ),
    on_sales(
        "region_metrics",
        regions.region_metrics,
        with_sales(
            f"""
SELECT region, {total('total_amount')} AS total_sales, COUNT(*) AS total_transactions,
  {mean('total_amount')} AS avg_transaction_value, {whole('SUM(quantity)')} AS total_quantity,
  COUNT(DISTINCT customer_id) AS unique_customers, {mean('discount_percent')} AS avg_discount,
  CAST(SUM(total_amount) AS DOUBLE) / NULLIF(COUNT(DISTINCT customer_id), 0) AS sales_per_customer
FROM sales GROUP BY region"""
        ),
        "region total_amount quantity customer_id discount_percent",
    ),
    on_sales(
        "region_channel",
        regions.region_channel,
        with_sales(
            f"""
SELECT region, sales_channel, {total('total_amount')} AS total_sales, COUNT(*) AS transaction_count
FROM sales GROUP BY region, sales_channel"""
        ),
        "region sales_channel total_amount",
    ),
    on_sales(
        "monthly_region_sales",
        regions.monthly_region_sales,
        with_sales(
            """
SELECT region, strftime(date, '%Y-%m') AS year_month, CAST(year(date) AS INTEGER) AS year,
  CAST(month(date) AS INTEGER) AS month, CAST(total AS DOUBLE) AS total_sales, n AS transaction_count,
  month_mean AS avg_transaction_value, date
FROM months""",
            REGION_MONTHS,
        ),
        "region date total_amount",
    ),
    on_sales(
        "region_month_pivot",
        lambda sales: regions.region_month_pivot(sales, PIVOT_MONTHS),
        with_sales(
            "SELECT region, "
            + ", ".join(
                f"CAST(SUM(total) FILTER (WHERE strftime(date, '%Y-%m') = '{m}') AS DOUBLE) AS \"{m}\""
                for m in PIVOT_MONTHS
            )
            + " FROM months WHERE region IS NOT NULL GROUP BY region",
            REGION_MONTHS,
        ),
        "region date total_amount",
    ),
    on_sales(
        "region_monthly_stats",
        regions.region_monthly_stats,
        with_sales(
            f"""
SELECT region, COALESCE(CAST(SUM(total) AS DOUBLE), 0.0) AS total_sales_sum,
  {rounded_mean('total')} AS total_sales_mean,
  round_even(stddev_samp(CAST(total AS DOUBLE)), 2) AS total_sales_std,
  {whole('SUM(n)')} AS transaction_count_sum,
  round_even(AVG(month_mean), 2) AS avg_transaction_value_mean
FROM months WHERE region IS NOT NULL GROUP BY region""",
            REGION_MONTHS,
        ),
        "region date total_amount",
    ),
    on_sales(
        "best_month_by_region", regions.best_month_by_region, picked_month("DESC"), "region date total_amount"
    ),
    on_sales(
        "worst_month_by_region", regions.worst_month_by_region, picked_month("ASC"), "region date total_amount"
    ),
    on_sales(
        "market_share",
        regions.market_share,
        with_sales(
            """
SELECT region, strftime(date, '%Y-%m') AS year_month, CAST(total AS DOUBLE) AS total_sales,
  CAST(total AS DOUBLE) / NULLIF(CAST(SUM(total) OVER (PARTITION BY date) AS DOUBLE), 0) AS market_share
FROM months""",
            REGION_MONTHS,
        ),
        "region date total_amount",
    ),
    on_products(
        "product_performance",
        products.product_performance,
        with_sales(PERFORMANCE),
        "product total_amount quantity unit_price discount_percent",
    ),
    on_products(
        "top_products",
        products.top_products,
        with_sales(
            f"SELECT * FROM ({PERFORMANCE}) ORDER BY total_sales DESC NULLS LAST, product ASC NULLS LAST LIMIT 10"
        ),
        "product total_amount quantity unit_price discount_percent",
    ),
    on_sales(
        "product_monthly",
        products.product_monthly,
        with_sales(
            f"""
SELECT product, strftime(month_start, '%Y-%m') AS year_month, CAST(year(month_start) AS INTEGER) AS year,
  CAST(month(month_start) AS INTEGER) AS month, total_sales, total_quantity, transaction_count,
  month_start AS date
FROM (SELECT product, CAST(date_trunc('month', date) AS DATE) AS month_start,
    {total('total_amount')} AS total_sales, {whole('SUM(quantity)')} AS total_quantity,
    COUNT(*) AS transaction_count
  FROM sales GROUP BY 1, 2)"""
        ),
        "product date total_amount quantity",
    ),
    on_sales(
        "top_product_trend",
        products.top_product_trend,
        with_sales(
            f"""
SELECT product, CAST(date_trunc('month', date) AS DATE) AS date, {total('total_amount')} AS total_sales
FROM sales WHERE product IN (SELECT product FROM ranked WHERE place <= 5) GROUP BY 1, 2""",
            PRODUCT_TOTALS,
        ),
        "product date total_amount",
    ),
    on_products(
        "product_quantity_vs_revenue",
        products.product_quantity_vs_revenue,
        with_sales(
            f"""
SELECT product, {whole('SUM(quantity)')} AS total_quantity, {total('total_amount')} AS total_sales
FROM sales GROUP BY product"""
        ),
        "product quantity total_amount",
    ),
    on_products(
        "product_profitability",
        products.product_profitability,
        with_sales(PROFITABILITY),
        "product total_amount unit_price discount_percent quantity",
    ),
    on_products(
        "top_profitable_products",
        products.top_profitable_products,
        with_sales(
            f"SELECT * FROM ({PROFITABILITY})"
            " ORDER BY revenue_per_unit DESC NULLS LAST, product ASC NULLS LAST LIMIT 10"
        ),
        "product total_amount unit_price discount_percent quantity",
    ),
    on_sales(
        "product_region",
        products.product_region,
        with_sales(
            f"""
SELECT product, region, {total('total_amount')} AS total_sales, {whole('SUM(quantity)')} AS quantity
FROM sales GROUP BY product, region"""
        ),
        "product region total_amount quantity",
    ),
    on_sales(
        "product_region_pivot",
        lambda sales: products.product_region_pivot(sales, 15, REGIONS),
        with_sales(
            matrix_cells("sales SEMI JOIN (SELECT product FROM ranked WHERE place <= 15) USING (product)"),
            PRODUCT_TOTALS,
        ),
        "product region total_amount",
    ),
    on_products(
        "product_summary",
        products.product_summary,
        with_sales(
            """
SELECT COUNT(*) AS n_products, MAX(product) FILTER (WHERE place = 1) AS top_product,
  CAST(MAX(total) FILTER (WHERE place = 1) AS DOUBLE) AS top_product_sales,
  CAST(SUM(total) AS DOUBLE) / COUNT(total) AS avg_product_sales,
  median(CAST(total AS DOUBLE)) AS median_product_sales
FROM ranked""",
            PRODUCT_TOTALS,
        ),
        "product total_amount",
    ),
    on_products(
        "product_summary_text",
        products.product_summary_text,
        with_sales(
            """
SELECT CAST(COUNT(*) AS VARCHAR) AS n_products,
  concat(MAX(product) FILTER (WHERE place = 1), ' ($',
    format('{:,.2f}', CAST(MAX(total) FILTER (WHERE place = 1) AS DOUBLE)), ')') AS top_product,
  '$' || format('{:,.2f}', CAST(SUM(total) AS DOUBLE) / COUNT(total)) AS avg_product_sales,
  '$' || format('{:,.2f}', median(CAST(total AS DOUBLE))) AS median_product_sales
FROM ranked""",
            PRODUCT_TOTALS,
        ),
        "product total_amount",
    ),
    on_products(
        "top_bottom_products",
        products.top_bottom_products,
        with_sales(
            """
SELECT 'top' AS side, CAST(place AS INTEGER) AS rank, product, CAST(total AS DOUBLE) AS total_sales
FROM ranked WHERE place <= 5
UNION ALL
SELECT 'bottom', CAST(place - greatest(n - 5, 0) AS INTEGER), product, CAST(total AS DOUBLE)
FROM ranked WHERE place > n - 5""",
            PRODUCT_TOTALS,
        ),
        "product total_amount",
    ),
    on_products(
        "top_bottom_products_text",
        products.top_bottom_products_text,
        with_sales(
            """
SELECT side, rank, product, '$' || format('{:,.2f}', CAST(total AS DOUBLE)) AS total_sales
FROM (SELECT 'top' AS side, CAST(place AS INTEGER) AS rank, product, total FROM ranked WHERE place <= 5
  UNION ALL SELECT 'bottom', CAST(place - greatest(n - 5, 0) AS INTEGER), product, total
  FROM ranked WHERE place > n - 5)""",
            PRODUCT_TOTALS,
        ),
        "product total_amount",
    ),
    on_products(
        "revenue_concentration",
        products.revenue_concentration,
        with_sales(
            """
SELECT *, top_k_revenue / NULLIF(total_revenue, 0) * 100 AS concentration_pct
FROM (SELECT CAST(SUM(total) FILTER (WHERE place <= 10) AS DOUBLE) AS top_k_revenue,
  CAST(SUM(total) AS DOUBLE) AS total_revenue FROM ranked)""",
            PRODUCT_TOTALS,
        ),
        "product total_amount",
    ),
    on_products(
        "revenue_concentration_text",
        products.revenue_concentration_text,
        with_sales(
            """
SELECT format('{:.1f}%', CAST(SUM(total) FILTER (WHERE place <= 10) AS DOUBLE)
  / NULLIF(CAST(SUM(total) AS DOUBLE), 0) * 100) AS concentration
FROM ranked""",
            PRODUCT_TOTALS,
        ),
        "product total_amount",
    ),
]

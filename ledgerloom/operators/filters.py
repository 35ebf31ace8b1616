"""Row filters and the values a filter can be chosen from.

Each filter argument is optional: ``None`` or an empty choice adds no predicate.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.dates import as_date, month_number
from ledgerloom.functions.ordering import largest_first
from ledgerloom.sources.schema import FOLDER_COLUMNS

DateRange = tuple[date | str, date | str]


def filtered_sales(
    sales: DataFrame,
    *,
    date_range: DateRange | None = None,
    regions: Iterable[str] | None = None,
    products: Iterable[str] | None = None,
) -> DataFrame:
    """Rows inside the inclusive date range, in the regions and among the products."""
    if date_range:
        start, end = (as_date(day) for day in date_range)
        sales = sales.where(F.col("date").between(start, end))
        if set(FOLDER_COLUMNS) <= set(sales.columns):
            # Same range on the folder columns of a table that write_sales wrote, so whole
            # month folders are skipped before any file is opened.
            year, month = map(F.col, FOLDER_COLUMNS)
            month = year * 12 + month
            sales = sales.where(month.between(month_number(start), month_number(end)))
    if regions:
        sales = sales.where(F.col("region").isin(*regions))
    if products:
        sales = sales.where(F.col("product").isin(*products))
    return sales


def distinct_regions(sales: DataFrame) -> DataFrame:
    return sales.select("region").distinct()


def top_product_names(sales: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` products of highest revenue; the metric is dropped."""
    return (
        sales.groupBy("product")
        .agg(F.sum("total_amount").alias("total_sales"))
        .orderBy(*largest_first("total_sales", "product"))
        .limit(k)
        .select("product")
    )


def date_bounds(sales: DataFrame) -> DataFrame:
    """First and last sale date."""
    return sales.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def top_product_rows(sales: DataFrame, k: int = 5) -> DataFrame:
    """Sales rows of the ``k`` products of highest revenue.

    The kept set has at most ``k`` rows, so Spark broadcasts it by its known size
    and the sales rows are not shuffled for the membership test.
    """
    return sales.join(top_product_names(sales, k), "product", "left_semi").select(*sales.columns)

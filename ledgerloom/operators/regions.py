"""Regional analyses.

Two null rules apply.  Whole-table analyses keep a null region as a group of its
own and give a null sum when all amounts are null.  Statistics over monthly totals
and everything in the filtered (dashboard) part drop null regions, and there an
all-null sum is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.dates import label_month_start, month_label, month_start
from ledgerloom.functions.distinct import parts_with_ids
from ledgerloom.functions.measures import mean, ratio, round_even, rounded_mean, total, total_or_zero
from ledgerloom.functions.ordering import ascending, largest_first, smallest_first
from ledgerloom.functions.parts import (
    ROWS,
    part_count_or_zero,
    part_mean,
    part_rounded_mean,
    part_total,
    part_total_or_zero,
)
from ledgerloom.operators.filters import filtered_sales


# --- whole-table analyses ---------------------------------------------------


def region_sales(sales: DataFrame) -> DataFrame:
    """Revenue per region, largest first."""
    return (
        sales.groupBy("region")
        .agg(
            total("total_amount").alias("total_sales"),
            mean("total_amount").alias("avg_sales"),
            F.count("*").alias("transaction_count"),
            mean("total_amount").alias("avg_transaction_value"),
        )
        .orderBy(*largest_first("total_sales", "region"))
    )


def region_metrics(sales: DataFrame) -> DataFrame:
    """Revenue, volume, customers and discount per region, largest revenue first."""
    return (
        _with_customers(sales, "total_amount", "quantity", "discount_percent")
        .select(
            "region",
            part_total("total_amount").alias("total_sales"),
            F.col(ROWS).alias("total_transactions"),
            part_mean("total_amount").alias("avg_transaction_value"),
            F.col("quantity_sum").alias("total_quantity"),
            "unique_customers",
            part_mean("discount_percent").alias("avg_discount"),
        )
        .withColumn("sales_per_customer", ratio("total_sales", "unique_customers"))
        .orderBy(*largest_first("total_sales", "region"))
    )


def region_channel(sales: DataFrame) -> DataFrame:
    """Revenue per region and channel."""
    return (
        sales.groupBy("region", "sales_channel")
        .agg(total("total_amount").alias("total_sales"), F.count("*").alias("transaction_count"))
        .orderBy(*ascending("region"), *largest_first("total_sales", "sales_channel"))
    )


def monthly_region_sales(sales: DataFrame) -> DataFrame:
    """Month series per region."""
    return (
        _region_months(sales)
        .select(
            "region",
            month_label("date").alias("year_month"),
            F.year("date").alias("year"),
            F.month("date").alias("month"),
            F.col("total").cast("double").alias("total_sales"),
            "transaction_count",
            "avg_transaction_value",
            "date",
        )
        .orderBy(*ascending("date", "region"))
    )


def region_month_pivot(sales: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Revenue matrix region x month; a missing cell stays null.

    Name the ``yyyy-MM`` months to fix the columns, skip the job that would look
    for them, and read only their date range.
    """
    if months:
        sales = sales.where(
            F.col("date").between(
                label_month_start(min(months)), F.last_day(label_month_start(max(months)))
            )
        )
    return (
        _region_months(sales)
        .where(F.col("region").isNotNull())
        .withColumn("year_month", month_label("date"))
        .groupBy("region")
        .pivot("year_month", list(months) if months else None)
        .agg(F.sum("total").cast("double"))
        .orderBy("region")
    )


def region_monthly_stats(sales: DataFrame) -> DataFrame:
    """Statistics of the monthly figures per region, rounded to two places.

    ``avg_transaction_value_mean`` is the unweighted mean of the monthly means: each
    month counts once, however many sales it has.
    """
    return (
        _known_region_months(sales)
        .groupBy("region")
        .agg(
            total_or_zero("total").alias("total_sales_sum"),
            rounded_mean("total").alias("total_sales_mean"),
            round_even(F.stddev_samp(F.col("total").cast("double"))).alias("total_sales_std"),
            F.sum("transaction_count").alias("transaction_count_sum"),
            round_even(F.avg("avg_transaction_value")).alias("avg_transaction_value_mean"),
        )
        .orderBy("region")
    )


def best_month_by_region(sales: DataFrame) -> DataFrame:
    """Month of highest revenue per region; the earliest month wins a tie."""
    return _picked_month(sales, largest_first("total", "date"))


def worst_month_by_region(sales: DataFrame) -> DataFrame:
    """Month of lowest revenue per region; the earliest month wins a tie."""
    return _picked_month(sales, smallest_first("total", "date"))


def market_share(sales: DataFrame) -> DataFrame:
    """Each region's share of the month's revenue."""
    month_total = F.sum("total").over(Window.partitionBy("date")).cast("double")
    return (
        _region_months(sales)
        .select(
            "region",
            month_label("date").alias("year_month"),
            F.col("total").cast("double").alias("total_sales"),
            ratio(F.col("total").cast("double"), month_total).alias("market_share"),
        )
        .orderBy(*ascending("year_month", "region"))
    )


# --- filtered (dashboard) analyses ------------------------------------------


def region_bar(sales: DataFrame, **filters) -> DataFrame:
    """Revenue and number of rows with a customer per region, smallest first."""
    return (
        _by_known_region(sales, filters)
        .agg(
            total_or_zero("total_amount").alias("total_amount"),
            F.count("customer_id").alias("transaction_count"),
        )
        .orderBy(*smallest_first("total_amount", "region"))
    )


def region_scatter(sales: DataFrame, **filters) -> DataFrame:
    """Customer count against sales per customer."""
    return (
        _with_customers(_known_regions(sales, filters), "total_amount", "quantity")
        .select(
            "region",
            part_total_or_zero("total_amount").alias("total_sales"),
            part_mean("total_amount").alias("avg_transaction"),
            "unique_customers",
            part_count_or_zero("quantity").alias("total_quantity"),
        )
        .withColumn("sales_per_customer", ratio("total_sales", "unique_customers"))
        .orderBy("region")
    )


def region_timeline(sales: DataFrame, **filters) -> DataFrame:
    """Revenue per month start and region."""
    return (
        _by_known_region(sales, filters, month_start("date").alias("date"))
        .agg(total_or_zero("total_amount").alias("total_amount"))
        .where(F.col("date").isNotNull())
        .select("date", "region", "total_amount")
        .orderBy("date", "region")
    )


def region_table(sales: DataFrame, **filters) -> DataFrame:
    """Region summary, rounded to two places."""
    rows = _known_regions(sales, filters).withColumn("customer", F.when(F.col("customer_id").isNotNull(), 1))
    return (
        _with_customers(rows, "total_amount", "quantity", "discount_percent", "customer")
        .select(
            "region",
            part_total_or_zero("total_amount").alias("total_sales"),
            part_rounded_mean("total_amount").alias("avg_transaction"),
            part_count_or_zero("quantity").alias("total_quantity"),
            F.col("customer_n").alias("total_transactions"),
            "unique_customers",
            part_rounded_mean("discount_percent").alias("avg_discount"),
        )
        .orderBy("region")
    )


# --- shared steps ------------------------------------------------------------


def _region_months(sales: DataFrame) -> DataFrame:
    """Monthly totals, still decimal.  Rows group on the month's first day: one date
    key; the year, month and label of a month are derived from the few groups."""
    return sales.groupBy("region", month_start("date").alias("date")).agg(
        F.sum("total_amount").alias("total"),
        F.count("*").alias("transaction_count"),
        mean("total_amount").alias("avg_transaction_value"),
    )


def _known_region_months(sales: DataFrame) -> DataFrame:
    return _region_months(sales).where(F.col("region").isNotNull())


def _picked_month(sales: DataFrame, order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("region").orderBy(*order))
    return (
        _known_region_months(sales)
        .where(F.col("total").isNotNull())
        .withColumn("place", place)
        .where(F.col("place") == 1)
        .select(
            "region",
            month_label("date").alias("year_month"),
            F.col("total").cast("double").alias("total_sales"),
        )
        .orderBy("region")
    )


def _known_regions(sales: DataFrame, filters: dict) -> DataFrame:
    return filtered_sales(sales, **filters).where(F.col("region").isNotNull())


def _by_known_region(sales: DataFrame, filters: dict, *keys: Column):
    return _known_regions(sales, filters).groupBy(*keys, "region")


def _with_customers(sales: DataFrame, *columns: str) -> DataFrame:
    """Additive parts per region and the number of different customers."""
    return parts_with_ids(sales, ["region"], columns, "customer_id", "unique_customers")

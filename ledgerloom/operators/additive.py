"""Whole-table analyses from additive parts, such as those kept with each batch of a stored table.

The results equal those of the operators of the same name on the sales themselves; the sales are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.dates import month_label
from ledgerloom.functions.distinct import BITS, SET_COLUMNS, merged_sets, set_sizes
from ledgerloom.functions.measures import percent_of, ratio
from ledgerloom.functions.ordering import ascending, largest_first
from ledgerloom.functions.parts import ROWS, merged, part_mean, part_total


def _sums(given: DataFrame, *keys: str) -> DataFrame:
    sums = [c for c in given.columns if c == ROWS or c.endswith(("_sum", "_n"))]
    return merged(given.where(~F.col("is_set")).select(*keys, *sums), keys)


def region_sales(given: DataFrame) -> DataFrame:
    return _sums(given, "region").select(
        "region",
        part_total("total_amount").alias("total_sales"),
        part_mean("total_amount").alias("avg_sales"),
        F.col(ROWS).alias("transaction_count"),
        part_mean("total_amount").alias("avg_transaction_value"),
    ).orderBy(*largest_first("total_sales", "region"))


def region_metrics(given: DataFrame) -> DataFrame:
    sets = merged_sets(given.where("is_set").select("region", *SET_COLUMNS, BITS), ["region"])
    sizes = set_sizes(sets, ["region"], "unique_customers").withColumnRenamed("region", "of_region")
    return (
        _sums(given, "region")
        .join(sizes, F.col("region").eqNullSafe(F.col("of_region")), "left")
        .select(
            "region",
            part_total("total_amount").alias("total_sales"),
            F.col(ROWS).alias("total_transactions"),
            part_mean("total_amount").alias("avg_transaction_value"),
            F.col("quantity_sum").alias("total_quantity"),
            F.coalesce("unique_customers", F.lit(0)).cast("bigint").alias("unique_customers"),
            part_mean("discount_percent").alias("avg_discount"),
        )
        .withColumn("sales_per_customer", ratio("total_sales", "unique_customers"))
        .orderBy(*largest_first("total_sales", "region"))
    )


def region_channel(given: DataFrame) -> DataFrame:
    return _sums(given, "region", "sales_channel").select(
        "region", "sales_channel", part_total("total_amount").alias("total_sales"), F.col(ROWS).alias("transaction_count")
    ).orderBy(*ascending("region"), *largest_first("total_sales", "sales_channel"))


def monthly_region_sales(given: DataFrame) -> DataFrame:
    return _sums(given, "region", "month").select(
        "region",
        month_label("month").alias("year_month"),
        F.year("month").alias("year"),
        F.month("month").alias("month"),
        part_total("total_amount").alias("total_sales"),
        F.col(ROWS).alias("transaction_count"),
        part_mean("total_amount").alias("avg_transaction_value"),
        F.col("month").alias("date"),
    ).orderBy(*ascending("date", "region"))


def product_performance(given: DataFrame) -> DataFrame:
    return (
        _sums(given, "product")
        .select(
            "product",
            part_total("total_amount").alias("total_sales"),
            F.col("quantity_sum").alias("total_quantity"),
            part_mean("unit_price").alias("avg_price"),
            F.col(ROWS).alias("transaction_count"),
            part_mean("discount_percent").alias("avg_discount"),
        )
        .withColumn("revenue_per_transaction", ratio("total_sales", "transaction_count"))
        .orderBy(*largest_first("total_sales", "product"))
    )


def product_profitability(given: DataFrame) -> DataFrame:
    return (
        _sums(given, "product")
        .select(
            "product",
            part_total("total_amount").alias("total_sales"),
            part_mean("unit_price").alias("avg_unit_price"),
            part_mean("discount_percent").alias("avg_discount"),
            F.col("quantity_sum").alias("total_quantity"),
        )
        .withColumn("revenue_per_unit", ratio("total_sales", "total_quantity"))
        .withColumn("discount_impact", percent_of("avg_unit_price", "avg_discount"))
        .orderBy(*largest_first("revenue_per_unit", "product"))
    )


def product_monthly(given: DataFrame) -> DataFrame:
    return _sums(given, "product", "month").select(
        "product",
        month_label("month").alias("year_month"),
        F.year("month").alias("year"),
        F.month("month").alias("month"),
        part_total("total_amount").alias("total_sales"),
        F.col("quantity_sum").alias("total_quantity"),
        F.col(ROWS).alias("transaction_count"),
        F.col("month").alias("date"),
    ).orderBy(*ascending("date", "product"))


def product_region(given: DataFrame) -> DataFrame:
    return _sums(given, "product", "region").select(
        "product", "region", part_total("total_amount").alias("total_sales"), F.col("quantity_sum").alias("quantity")
    ).orderBy(*ascending("product", "region"))

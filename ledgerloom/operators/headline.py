"""Headline figures of the filtered sales, as values and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.distinct import parts_with_ids
from ledgerloom.functions.parts import ROWS, part_mean, part_total_or_zero
from ledgerloom.functions.text import dollars, grouped_text, plain_text
from ledgerloom.operators.filters import filtered_sales


def kpi_values(sales: DataFrame, **filters) -> DataFrame:
    """Revenue, rows, mean amount and distinct customers in one pass; always one row."""
    rows = filtered_sales(sales, **filters)
    return parts_with_ids(rows, [], ["total_amount"], "customer_id", "unique_customers").select(
        part_total_or_zero("total_amount").alias("total_sales"),
        F.coalesce(ROWS, F.lit(0)).cast("bigint").alias("total_transactions"),
        part_mean("total_amount").alias("avg_transaction"),
        "unique_customers",
    )


def kpi_text(sales: DataFrame, **filters) -> DataFrame:
    """:func:`kpi_values` as display text; zeros when no row passes the filter."""
    return kpi_as_text(kpi_values(sales, **filters))


def kpi_as_text(values: DataFrame) -> DataFrame:
    """Headline figures as display text."""
    empty = F.col("total_transactions") == 0
    mean_text = F.coalesce(plain_text(F.col("avg_transaction"), 2), F.lit("nan"))
    return values.select(
        F.when(empty, "$0").otherwise(dollars(grouped_text(F.col("total_sales")))).alias("total_sales"),
        grouped_text(F.col("total_transactions")).alias("total_transactions"),
        F.when(empty, "$0").otherwise(dollars(mean_text)).alias("avg_transaction"),
        grouped_text(F.col("unique_customers")).alias("unique_customers"),
    )

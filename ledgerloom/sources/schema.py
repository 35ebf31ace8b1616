"""The ``sales`` table: one row per transaction line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Documented columns, in order, with the types results are given in.
DOCUMENTED_TYPES = {
    "transaction_id": "string",
    "date": "date",
    "product": "string",
    "quantity": "bigint",
    "unit_price": "double",
    "customer_id": "string",
    "customer_name": "string",
    "customer_email": "string",
    "customer_segment": "string",
    "region": "string",
    "sales_channel": "string",
    "salesperson": "string",
    "salesperson_tier": "string",
    "discount_percent": "double",
    "total_amount": "double",
}

# Money and percentages are decimal inside a plan, so that sums are exact.
EXACT_TYPES = DOCUMENTED_TYPES | {
    "unit_price": "decimal(12,2)",
    "discount_percent": "decimal(5,2)",
    "total_amount": "decimal(14,2)",
}

SALES_COLUMNS = tuple(DOCUMENTED_TYPES)

# Folder columns of written tables: a year and month of the sale date under names that no
# caller's own column is likely to have.
FOLDER_COLUMNS = ("_sale_year", "_sale_month")

SALES_SCHEMA = ", ".join(f"`{name}` {type_}" for name, type_ in DOCUMENTED_TYPES.items())


def conform(frame: DataFrame) -> DataFrame:
    """Cast the documented columns to the exact types; keep other columns as they are."""
    return frame.select(
        *[
            F.col(name).cast(EXACT_TYPES[name]).alias(name) if name in EXACT_TYPES else F.col(name)
            for name in frame.columns
        ]
    )


def documented(frame: DataFrame) -> DataFrame:
    """The documented columns that are present, in their documented types."""
    return frame.select(
        *[
            F.col(name).cast(type_).alias(name)
            for name, type_ in DOCUMENTED_TYPES.items()
            if name in frame.columns
        ]
    )

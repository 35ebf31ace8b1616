"""Pricing, discount and assignment rules as table transformations.

All rules work row by row on literal lookups, so none of them shuffles the sales (account
positions, the one exception, are computed over distinct customers).  Every rule takes its
table as an argument, a mapping or a DataFrame of key and value; a DataFrame is joined.  A
label that a rule's table does not know leaves the value as it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.lookup import lookup, with_value
from ledgerloom.functions.measures import net_of_discount
from ledgerloom.functions.position import with_position
from ledgerloom.operators import rulebook as book

FACTOR = "decimal(6,4)"
Table = Mapping[str, Any] | DataFrame


# --- pricing -----------------------------------------------------------------


def net_amount(sales: DataFrame) -> DataFrame:
    """Add subtotal, discount amount and net amount, and whether the stored total agrees."""
    net = net_of_discount(F.col("quantity"), F.col("unit_price"), F.col("discount_percent"))
    subtotal = F.col("quantity").cast("decimal(10,0)") * F.col("unit_price").cast("decimal(12,2)")
    discount = subtotal * F.col("discount_percent").cast("decimal(5,2)") * F.lit("0.01").cast("decimal(2,2)")
    return sales.withColumns(
        {
            "subtotal": subtotal,
            "discount_amount": discount.cast("decimal(32,6)"),
            "net_amount": net,
            "total_matches": net == F.col("total_amount"),
        }
    )


def seasonal_factor(
    sales: DataFrame,
    factors: Table = book.SEASONAL_FACTORS,
    seasons: Mapping[Sequence[int], str] = book.SEASONS,
) -> DataFrame:
    """Add the product's demand factor, raised in the high-season months."""
    known = with_value(sales, factors, "product", "decimal(4,2)", "_base")
    season = None
    for months, multiplier in seasons.items():
        in_season, value = F.month("date").isin(*months), F.lit(multiplier)
        season = season.when(in_season, value) if season is not None else F.when(in_season, value)
    season = F.lit("1") if season is None else season.otherwise(F.lit("1"))
    base = F.coalesce("_base", F.lit(1).cast("decimal(4,2)"))
    return known.withColumn("seasonal_factor", (base * season.cast("decimal(2,1)")).cast(FACTOR)).drop("_base")


def regional_factor(
    sales: DataFrame,
    strength: Table = book.REGION_STRENGTH,
    adoption: Table = book.REGION_ADOPTION,
    technology: Sequence[str] = book.TECHNOLOGY_PRODUCTS,
) -> DataFrame:
    """Add the region's price factor: economic strength, averaged with technology
    adoption for technology products."""
    known = with_value(sales, strength, "region", "decimal(3,2)", "_strength")
    known = with_value(known, adoption, "region", "decimal(3,2)", "_adoption")
    one, half = F.lit(1).cast("decimal(3,2)"), F.lit("0.5").cast("decimal(1,1)")
    strong, adopted = F.coalesce("_strength", one), F.coalesce("_adoption", one)
    factor = F.when(F.col("product").isin(*technology), (strong + adopted) * half).otherwise(strong)
    return known.withColumn("regional_factor", factor.cast(FACTOR)).drop("_strength", "_adoption")


def segment_factor(sales: DataFrame, multipliers: Table = book.SEGMENT_MULTIPLIERS) -> DataFrame:
    """Add the segment's price multiplier and the unit price under it."""
    known = with_value(sales, multipliers, "customer_segment", "decimal(3,1)", "_multiplier")
    factor = F.coalesce("_multiplier", F.lit(1).cast("decimal(3,1)")).cast("decimal(3,1)")
    return known.withColumns(
        {"segment_factor": factor, "segment_price": _price(F.col("unit_price") * factor)}
    ).drop("_multiplier")


def adjusted_price(
    sales: DataFrame,
    factors: Table = book.SEASONAL_FACTORS,
    strength: Table = book.REGION_STRENGTH,
    adoption: Table = book.REGION_ADOPTION,
    multipliers: Table = book.SEGMENT_MULTIPLIERS,
) -> DataFrame:
    """Add the unit price after season, region and segment, in that order."""
    known = segment_factor(regional_factor(seasonal_factor(sales, factors), strength, adoption), multipliers)
    price = F.col("unit_price") * F.col("seasonal_factor") * F.col("regional_factor") * F.col("segment_factor")
    return known.withColumn("adjusted_price", _price(price)).select(*sales.columns, "adjusted_price")


# --- discounts ---------------------------------------------------------------


def discount_bounds(
    sales: DataFrame,
    channels: Mapping[str, tuple[int, int]] = book.CHANNEL_DISCOUNTS,
    other: tuple[int, int] = book.OTHER_CHANNEL_DISCOUNT,
    tiers: Mapping[int, tuple[str, tuple[int, int]]] = book.VOLUME_TIERS,
) -> DataFrame:
    """Add the allowed discount range and whether the stored discount keeps to it.

    The range is the channel's plus the volume tier's; no discount at all is always
    allowed.  A quantity below every tier's least one (a return) is in the lowest tier.
    """

    def bound(end: int) -> Column:
        base = F.coalesce(
            lookup({name: ends[end] for name, ends in channels.items()}, "sales_channel", "decimal(5,2)"),
            F.lit(other[end]).cast("decimal(5,2)"),
        )
        added = _by_volume(F.col("quantity"), tiers, lambda _, ends: ends[end]).cast("decimal(5,2)")
        return (base + added).cast("decimal(5,2)")

    low, high = bound(0), bound(1)
    given = F.col("discount_percent")
    return sales.withColumns(
        {
            "min_pct": low,
            "max_pct": high,
            "volume_tier": _by_volume(F.col("quantity"), tiers, lambda tier, _: tier),
            "in_bounds": (given == 0) | given.between(low, high),
        }
    )


def tier_adjusted_discount(sales: DataFrame, multipliers: Table = book.TIER_MULTIPLIERS) -> DataFrame:
    """Add the discount after the salesperson's tier: strong tiers give less, weak more."""
    known = with_value(sales, multipliers, "salesperson_tier", FACTOR, "_tier")
    tier = F.col("_tier")
    change = (
        F.when(tier > 1, F.lit(book.GOOD_TIER_DISCOUNT))
        .when(tier < 1, F.lit(book.POOR_TIER_DISCOUNT))
        .otherwise(F.lit("1"))
        .cast("decimal(2,1)")
    )
    return known.withColumn(
        "adjusted_discount",
        F.round(F.col("discount_percent").cast("decimal(5,2)") * change, 2).cast("decimal(6,2)"),
    ).drop("_tier")


# --- assignment --------------------------------------------------------------


def account_assignment(customers: DataFrame, accounts: int, key: str = "customer_id") -> DataFrame:
    """Split the distinct customers, in key order, into ``accounts`` contiguous blocks of
    ``floor(n / accounts)``; the last block takes the remainder.

    Blocks are numbered from 0.  With fewer customers than accounts all of them fall
    into the last block.
    """
    if accounts < 1:
        raise ValueError("accounts must be at least 1")
    distinct = customers.select(key).where(F.col(key).isNotNull()).distinct()
    size = F.call_function("div", distinct.agg(F.count("*")).scalar(), F.lit(accounts))
    block = F.call_function("div", F.col("_position") - 1, F.nullif(F.col("_size"), F.lit(0)))
    return (
        with_position(distinct, key, "_position")
        .withColumn("_size", size)
        .select(
            key,
            F.least(F.coalesce(block, F.lit(accounts - 1)), F.lit(accounts - 1))
            .cast("int")
            .alias("account"),
        )
    )


def account_sales(sales: DataFrame, assignment: DataFrame, key: str = "customer_id") -> DataFrame:
    """Revenue and sales of each account's customers.

    Sales are summed per customer before the join, so a customer with very many
    sales is one row when it is shuffled.
    """
    per_customer = sales.groupBy(key).agg(
        F.sum("total_amount").alias("total"), F.count("*").alias("rows")
    )
    return (
        per_customer.join(assignment, key)
        .groupBy("account")
        .agg(
            F.sum("total").cast("double").alias("total_sales"),
            F.sum("rows").alias("transaction_count"),
            F.count("*").alias("active_customers"),
        )
        .orderBy("account")
    )


def performer_label(frame: DataFrame, suffixes: Table = book.TIER_SUFFIXES) -> DataFrame:
    """Add the salesperson's name with the tier suffix."""
    known = with_value(frame, suffixes, "salesperson_tier", "string", "_suffix")
    label = F.concat("salesperson", F.coalesce("_suffix", F.lit("")))
    return known.withColumn("performer_label", label).drop("_suffix")


def history_window(sales: DataFrame, days: int = book.HISTORY_DAYS, as_of: Any = None) -> DataFrame:
    """Add whether a sale lies in the ``days`` before ``as_of``, both ends included.

    Without ``as_of`` the latest sale date counts as today; the clock is never read.
    """
    today = F.lit(as_of).cast("date") if as_of else sales.agg(F.max("date")).scalar()
    return sales.withColumn("window_start", F.date_sub(today, days)).withColumn(
        "in_window", F.col("date").between(F.col("window_start"), F.date_add("window_start", days))
    )


# --- shared steps ------------------------------------------------------------


def _price(price: Column) -> Column:
    return F.round(price, 2).cast("decimal(14,2)")


def _by_volume(quantity: Column, tiers: Mapping[int, tuple[str, tuple[int, int]]], value) -> Column:
    chosen, lowest = None, min(tiers)
    for least in sorted(tiers, reverse=True):
        reached, result = quantity >= least, F.lit(value(*tiers[least]))
        chosen = chosen.when(reached, result) if chosen is not None else F.when(reached, result)
    return chosen.otherwise(F.lit(value(*tiers[lowest])))

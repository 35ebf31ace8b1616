"""Aggregate expressions with pinned numeric behaviour.

Money is decimal inside a plan, so sums are exact and do not depend on how rows
were spread over tasks; results leave as double.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(column: str) -> Column:
    """Sum; null when every value in the group is null."""
    return F.sum(column).cast("double")


def total_or_zero(column: str) -> Column:
    """Sum; 0 when every value in the group is null or there are no rows."""
    return F.coalesce(total(column), F.lit(0.0))


def count_sum_or_zero(column: str) -> Column:
    """Integer sum; 0 when every value in the group is null."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def mean(column: str) -> Column:
    """Exact sum over the number of non-null values, as double."""
    return F.try_divide(total(column), F.count(column))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Division that yields null, not an error, on a zero denominator."""
    return F.try_divide(_col(numerator), _col(denominator))


def percent_of(value: str | Column, percent: str | Column) -> Column:
    """``percent`` per cent of ``value``."""
    return _col(value) * (_col(percent) / F.lit(100))


def rounded_mean(column: str) -> Column:
    """Mean of a two-place decimal column, rounded half-even to two places.

    Rounding a mean that is already a double is wrong at half cents, so the
    decision is taken on whole cents: quotient, remainder, and the remainder
    compared with half the count.
    """
    return rounded_quotient(F.sum(column), F.count(column))


def rounded_quotient(amount: Column, count: Column) -> Column:
    """A two-place decimal over a count, rounded half-even to two places; null for a count of 0."""
    cents = (amount.cast("decimal(34,2)") * F.lit(100)).cast("decimal(36,0)")
    size = F.abs(cents)
    n = F.nullif(count, F.lit(0))
    quotient = F.call_function("div", size, n)
    twice_rest = (size % n) * 2
    up = (twice_rest > n) | ((twice_rest == n) & (quotient % 2 == 1))
    rounded = quotient + F.when(up, 1).otherwise(0)
    signed = F.when(cents < 0, -rounded).otherwise(rounded)
    return signed.cast("double") / F.lit(100.0)


def round_even(value: str | Column, places: int = 2) -> Column:
    """Half-even rounding of a double."""
    return F.bround(_col(value), places)


def net_of_discount(quantity: Column, unit_price: Column, discount_percent: Column) -> Column:
    """``quantity * unit_price`` less the discount, to whole cents, half up.

    The operand types are chosen so the exact product fits in 38 digits and no
    intermediate scale is cut.
    """
    subtotal = quantity.cast("decimal(10,0)") * unit_price.cast("decimal(12,2)")
    kept_percent = (F.lit(100) - discount_percent).cast("decimal(6,2)")
    hundredth = F.lit("0.01").cast("decimal(2,2)")
    return F.round(subtotal * kept_percent * hundredth, 2).cast("decimal(14,2)")


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value

"""Exact order statistics without a sort."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

BUCKETS = 1024


def middle_values(frame: DataFrame, column: str, buckets: int = BUCKETS) -> tuple[int, int] | None:
    """The two values in the middle of a whole-number column's order (the same one twice if their number is
    odd); null if there is no value that is not null.

    Each pass counts the values that are left in equal ranges and goes on inside the range that
    holds the middle, narrowed to the smallest and largest value in it.  So a pass brings at most
    ``buckets`` rows to the driver, no task gathers or sorts values, and the number of passes is
    at most the logarithm of the values' spread, to the base ``buckets`` (eight for 80 bits); where
    values differ much or not at all it is one or two.  The frame is read once a pass: keep it.
    """
    value = F.col(column).cast("decimal(38,0)")
    known = frame.where(F.col(column).isNotNull()).select(value.alias("_v"))
    n, low, high = known.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
    if not n:
        return None
    low, high = int(low), int(high)
    at, second = (n - 1) // 2, n // 2 - (n - 1) // 2  # places left of the middle; 1 if there are two
    while low < high:
        width = (high - low) // buckets + 1
        decimal = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
        place = F.call_function("div", F.col("_v") - decimal(low), decimal(width))
        found = (
            known.where(F.col("_v").between(decimal(low), decimal(high)))
            .groupBy(place.alias("at"))
            .agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
            .collect()
        )
        found.sort(key=lambda r: r["at"])
        for number, row in enumerate(found):
            if at < row["n"]:
                break
            at -= row["n"]
        if at + second >= row["n"]:  # the middle lies between two ranges
            return int(row["high"]), int(found[number + 1]["low"])
        low, high = int(row["low"]), int(row["high"])
    return low, low

"""Global row position without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RANGES = 1024
KEYS_PER_SPLIT = 4


def with_position(frame: DataFrame, key: str, column: str, ranges: int = RANGES) -> DataFrame:
    """Add the 1-based position of each row in ascending order of a unique ``key``; a null
    key comes last.

    A window without a partition would sort everything in one task.  Instead the
    rows are cut into up to ``ranges`` key ranges (a job with more tasks than that asks
    for more), numbered inside their range, and shifted by the size of the ranges before it.

    The range limits come from the rows with the smallest key hashes, so they are
    an even sample of the keys that is the same in every evaluation and after a
    lost executor.  They only steer the balance: the position is exact for any
    limits.  What is gathered in one place is bounded: four sampled keys and one
    count per range.
    """
    n_splits = max(1, ranges - 1)
    steps = [2**i for i in reversed(range(n_splits.bit_length()))]
    sample = (
        frame.select(key)
        .where(F.col(key).isNotNull())
        .orderBy(F.xxhash64(key), key)
        .limit(n_splits * KEYS_PER_SPLIT)
    )
    every_nth = F.filter(
        F.array_sort(F.collect_list(key)),
        lambda _, i: i % KEYS_PER_SPLIT == KEYS_PER_SPLIT - 1,
    )
    splits = sample.agg(every_nth.alias("_splits")).scalar()

    # Binary search: the number of limits that are <= the key.  Reading past the
    # end of a short array gives null, which counts as "greater".  Null keys get the
    # range behind all others.
    ranged = frame.withColumn("_splits", splits).withColumn(
        "_range",
        F.when(F.col(key).isNull(), F.lit(n_splits + 1)).otherwise(F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, step: F.when(
                F.get(F.col("_splits"), at + step - 1) <= F.col(key), at + step
            ).otherwise(at),
        )),
    ).drop("_splits")

    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    # One row per range (at most ``ranges`` + 1), so this window is small by construction.
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    # Every range has a start; the join is a left one so that no "range is known"
    # predicate is inferred, which would run the search a second time in the scan.
    inside = Window.partitionBy("_range").orderBy(F.asc_nulls_last(key))
    return (
        ranged.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(starts), "_range", "left")
        .withColumn(column, (F.col("_start") + F.col("_place")).cast("bigint"))
        .drop("_range", "_place", "_start")
    )

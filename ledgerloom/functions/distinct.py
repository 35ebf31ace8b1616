"""Exact distinct counts that add up: sets of ids as 64-bit words.

An id that is a whole number in its usual spelling is one bit of the word ``number >> 6``; any other id is
a word of its own.  Words are ORed like sums are added, in any order and in steps, across
tasks, groups and batches of rows, so they can be kept as parts next to sums.  A shuffle
carries a row per group and word: a 64th of the (group, id) pairs where ids are dense, and
never more rows than these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.parts import merged, parts

WORD, OTHER, BITS = "_word", "_other", "_bits"
SET_COLUMNS = (WORD, OTHER)


def word_columns(identifier: str) -> dict[str, Column]:
    """The word that an id's bit lies in, the id itself where it is no number, and the bit.  All three
    are null for a null id."""
    spelled = F.col(identifier).cast("string")
    number = spelled.try_cast("bigint")
    usual = number.cast("string") == spelled
    bit = F.expr(f"shiftleft(1L, cast(try_cast(cast(`{identifier}` as string) as bigint) & 63 as int))")
    return {
        WORD: F.when(usual, F.shiftright(number, 6)),
        OTHER: F.when(~F.coalesce(usual, F.lit(False)), spelled),
        BITS: F.when(usual, bit).when(spelled.isNotNull(), F.lit(1).cast("bigint")),
    }


def ored() -> Column:
    """The words of a group put together."""
    return F.bit_or(BITS).alias(BITS)


def id_sets(frame: DataFrame, keys: Sequence[str], identifier: str) -> DataFrame:
    """The set of ids of each group, as rows (keys, word, other, bits); null ids are in no set."""
    rows = frame.where(F.col(identifier).isNotNull()).select(*keys, *[c.alias(n) for n, c in word_columns(identifier).items()])
    return rows.groupBy(*keys, *SET_COLUMNS).agg(ored())


def merged_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sets of finer keys, or of several batches, put together."""
    return sets.groupBy(*keys, *SET_COLUMNS).agg(ored())


def set_sizes(sets: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number of ids per group.  A group's words must be merged; without keys there is one row, with 0
    for no ids."""
    return sets.groupBy(*keys).agg(F.coalesce(F.sum(F.bit_count(BITS)), F.lit(0)).cast("bigint").alias(name))


def parts_with_ids(frame: DataFrame, keys: Sequence[str], columns: Sequence[str], identifier: str, name: str) -> DataFrame:
    """Additive parts of ``columns`` per key, and the number ``name`` of different ids.

    Rows are first summed per key and word, so the shuffle carries a row per word and not one per id.
    """
    words = word_columns(identifier)
    keyed = frame.select(*keys, *columns, *[c.alias(n) for n, c in words.items()])
    by_word = parts(keyed, [*keys, *SET_COLUMNS], columns, ored())
    sums = [c for c in by_word.columns if c not in (*keys, *SET_COLUMNS, BITS)]
    ids = by_word.withColumn(name, F.bit_count(BITS).cast("bigint")).select(*keys, *sums, name)
    return merged(ids, keys).withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))

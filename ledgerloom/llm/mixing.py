"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken ``target / size of the source`` times.  The
whole part of that number is certain.  The fractions are rounded by pivotal steps: two
documents meet, one passes probability mass to the other until one of the two is a whole
number, and the one that is still fractional meets the next.  Documents meet others of
like size in blocks of bounded length; what is left of a block (one document) goes up a
tree of further rounds until one document per source is left.  So the expected number of
copies is kept for every document, the number taken is exact but for one copy per source,
and because neighbours have like sizes the words taken stay near the target.

Only DataFrame functions are used.  A block is a window partition of bounded length, so no
source, however large, meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.position import with_position
from ledgerloom.llm.common import staged, word_count

REPEATS_AT_A_TIME = 10_000  # equal rows that one task unfolds
ONE = 2**40  # probability mass in whole units, so that running sums are exact
BLOCK = 250
SEED = 6


def mixed(
    items: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    block: int = BLOCK,
) -> DataFrame:
    """How many copies of each document the mix takes.

    ``items`` has ``doc_id``, ``source``, ``size`` (words) and ``digest`` (a hash of the row's
    content).  Sources in code point order, null last, have the weights in turn; together
    they get ``share`` of all words, none more than ``most`` times its own.

    Returns one row per distinct item: its columns, ``n_rows`` (equal rows in the input),
    ``source_size``, ``target`` of the source and ``copies`` of all those rows together, at
    most ``most * n_rows``.  Equal rows can't be told apart and are rounded as one item;
    ``spread`` deals their copies out.  Null ids and sources are values like others.  Words
    of size 0 may be copied but add nothing; a source without words has target 0 and is not
    taken.  No rows give no rows.  Reruns agree: the draws are hashes of id and digest.
    """
    items = staged(
        items.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n_rows")), "mix-items"
    )
    sized = F.floor(F.log2(F.col("size") + 1) * 4).cast("int")
    classes = staged(
        items.groupBy("source", sized.alias("class")).agg(
            F.sum(F.col("size") * F.col("n_rows")).alias("words"), F.count("*").alias("n_items")
        ),
        "mix-classes",
    )
    targets = _targets(classes, weights, share, most)
    rates = classes.join(targets, classes["source"].eqNullSafe(targets["in_source"])).select(
        F.col("source").alias("c_source"),
        F.col("class").alias("c_class"),
        "source_size",
        "target",
        F.ceil(F.col("n_items") / block).alias("blocks"),
    )
    wanted = F.when(
        F.col("source_size") > 0, F.col("n_rows") * F.col("target") / F.col("source_size")
    ).otherwise(F.lit(0.0))
    placed = (
        items.withColumn("class", sized)
        .join(rates, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")), "left")
        .withColumn("wanted", wanted)
        .withColumn("base", F.floor("wanted").cast("bigint"))
        .withColumn("mass", F.round((F.col("wanted") - F.col("base")) * ONE).cast("bigint"))
        .withColumn("block", F.pmod(_draw_bits(0), F.col("blocks")))
        .drop("c_source", "c_class", "blocks", "wanted")
    )
    # The leaves: all documents.  Above: what is left over, one document per block.
    round_no, parts = 1, []
    level = staged(_pivotal(placed, ["source", "class", "block"], round_no), "mix-round")
    while True:
        parts.append(level.where(F.col("bit").isNotNull()))
        rest = level.where(F.col("bit").isNull()).drop("bit")
        merged = F.shiftright("class", 3) if round_no == 1 else F.lit(0)
        rest = staged(rest.withColumn("class", merged), "mix-rest")
        groups = rest.groupBy("source", "class").agg(F.count("*").alias("n"))
        largest = groups.agg(F.max("n")).first()[0] or 0
        if largest <= 1 and round_no >= 2:
            break
        round_no += 1
        counts = groups.select(
            F.col("source").alias("c_source"), F.col("class").alias("c_class"), F.ceil(F.col("n") / block).alias("blocks")
        )
        placed = (
            rest.join(counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")))
            .withColumn("block", F.pmod(_draw_bits(round_no), F.col("blocks")))
            .drop("c_source", "c_class", "blocks")
        )
        level = staged(_pivotal(placed, ["source", "class", "block"], round_no), "mix-round")
    last = (_uniform(99) * ONE < F.col("mass")).cast("bigint")
    parts.append(rest.withColumn("bit", last).select(level.columns))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(
        "doc_id", "source", "size", "digest", "n_rows", "source_size", "target",
        (F.col("base") + F.col("bit")).alias("copies"),
    )


def spread(taken: DataFrame) -> DataFrame:
    """One row per input row: the copies of equal rows, dealt out evenly (column ``copies``).

    Rows that repeat a great many times unfold in two steps, dealt out in between, so that no
    task makes them all.
    """
    even = F.floor(F.col("all_copies") / F.col("n_rows"))
    extra = (F.col("_at") <= F.col("all_copies") % F.col("n_rows")).cast("bigint")
    one = F.lit(1).cast("bigint")
    rows = taken.withColumnRenamed("copies", "all_copies")
    few = rows.where(F.col("n_rows") <= REPEATS_AT_A_TIME).withColumn("_at", F.explode(F.sequence(one, F.col("n_rows"))))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_rows") - 1) / REPEATS_AT_A_TIME)))
    many = rows.where(F.col("n_rows") > REPEATS_AT_A_TIME).withColumn("_block", blocks).repartition("doc_id", "digest", "_block")
    first = F.col("_block") * REPEATS_AT_A_TIME
    last = F.least(first + REPEATS_AT_A_TIME, F.col("n_rows"))
    many = many.withColumn("_at", F.explode(F.sequence(first + one, last))).drop("_block")
    return few.unionByName(many).withColumn("copies", even + extra).drop("_at", "all_copies")


def sized_items(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Items of ``mixed`` from documents; a null text has size 0."""
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        F.xxhash64(F.col(f"`{text}`")).alias("digest"),
    )


def _targets(classes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Target words of each source.  A level is raised until the words asked for are dealt
    out: a source gets level times weight, or its cap if that is less.  Each pass deals the
    excess of the sources found above their cap to the others, until none is above.  A pass
    is one sum over the sources; only three numbers reach the driver."""
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = with_position(sources, "source", "_rank").withColumn(
        "weight", F.get(cycle, (F.pmod(F.col("_rank") - 1, F.lit(len(weights)))).cast("int"))
    )
    ranked = staged(ranked.drop("_rank"), "mix-sources")
    cap = F.col("source_size") * most
    asked = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        sums = ranked.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if not sums[1]:
            break
        raised = (asked - sums[0]) / sums[1]
        if raised <= level:
            break
        level = raised
    return ranked.select(
        F.col("source").alias("in_source"),
        "source_size",
        F.least(cap.cast("double"), F.col("weight") * F.lit(level)).alias("target"),
    )


def _draw_bits(salt: int) -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("digest"), F.col("size"), F.lit(SEED * 1000 + salt))


def _uniform(salt: int) -> Column:
    """A draw in [0, 1), a function of the row."""
    return F.shiftrightunsigned(_draw_bits(500 + salt), 11) / F.lit(float(2**53))


def _pivotal(placed: DataFrame, keys: list[str], salt: int) -> DataFrame:
    """One pivotal round inside every block, in order of size.

    The running sum of masses tells, at each row, what the document held so far has (``held``)
    and whether the two together reach a whole copy.  A draw decides whether the new
    document takes over.  The loser of a meeting is settled: 1 if the sum went past a
    whole, else 0.  A document that took over is settled where the next one takes over.
    The last one held keeps the rest of the block's mass and has ``bit`` null; a rest of
    nothing means that it got its whole copy.
    """
    order = [F.col("size"), F.col("doc_id"), F.col("digest")]
    nonzero = F.when(F.col("mass") > 0, 1).otherwise(0)
    window = Window.partitionBy(*keys, "_live").orderBy(*order)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = window.rowsBetween(1, Window.unboundedFollowing)
    all_rows = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.pmod(F.col("_sum") - F.col("mass"), F.lit(ONE))
    both = F.col("_held") + F.col("mass")
    takes = (
        F.when(F.col("_held") == 0, True)
        .when(F.col("_both") <= ONE, _uniform(salt) * F.col("_both") < F.col("mass"))
        .otherwise(_uniform(salt) * (2 * ONE - F.col("_both")) < ONE - F.col("mass"))
    )
    loses_at = ((F.col("_held") == 0) | (F.col("_both") > ONE)).cast("bigint")
    rest = F.pmod(F.col("_total"), F.lit(ONE))
    bit = (
        F.when(F.col("_live") == 0, F.lit(0))
        .when(~F.col("_takes"), (F.col("_both") > ONE).cast("bigint"))
        .when(F.col("_settled").isNotNull(), F.col("_settled"))
        .when(rest == 0, F.lit(1))
    )
    return (
        placed.withColumn("_live", nonzero)
        .withColumn("_sum", F.sum("mass").over(so_far))
        .withColumn("_total", F.sum("mass").over(all_rows))
        .withColumn("_held", held)
        .withColumn("_both", both)
        .withColumn("_takes", takes)
        .withColumn("_loses_at", loses_at)
        .withColumn("_settled", F.first(F.when(F.col("_takes"), F.col("_loses_at")), ignorenulls=True).over(later))
        .withColumn("bit", bit.cast("bigint"))
        .withColumn("mass", F.when(F.col("bit").isNull(), rest).otherwise(F.col("mass")))
        .drop("_live", "_sum", "_total", "_held", "_both", "_takes", "_loses_at", "_settled", "block")
    )

"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import staged


def roots(links: DataFrame) -> DataFrame:
    """For each node with a link (``a``, ``b``, not null) the smallest node it is linked with,
    directly or through others: ``node``, ``root``.

    Each round links every node's larger neighbours to its smallest neighbour, then every
    node's smaller neighbours likewise, until a round changes nothing; the number of rounds
    grows with the logarithm of the longest chain.  A round is two groupings with map-side
    minima and two joins, and its result is written, so no group is gathered and a lost
    executor costs one round.  Links may repeat, point both ways or to the node itself.
    """
    ordered = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    edges = staged(ordered.where("node != root").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        smallest = both.groupBy("node").agg(F.min("root").alias("low")).select(
            F.col("node").alias("center"), F.least("node", "low").alias("low")
        )
        # large star: every neighbour larger than the node goes to the smallest around it
        large = (
            both.where(F.col("root") > F.col("node"))
            .join(smallest, F.col("node") == F.col("center"))
            .select(F.col("root").alias("node"), F.col("low").alias("root"))
            .distinct()
        )
        large = staged(large, "links")
        # small star: a node and its smaller neighbours go to the smallest of these
        lowest = large.groupBy("node").agg(F.min("root").alias("low")).select(F.col("node").alias("center"), "low")
        small = (
            large.join(lowest, F.col("node") == F.col("center"))
            .select(F.inline(F.array(F.struct(F.col("node").alias("node"), F.col("low").alias("root")), F.struct(F.col("root").alias("node"), F.col("low").alias("root")))))
            .where("node != root")
            .distinct()
        )
        small = staged(small, "links")
        sums = lambda f: tuple(f.agg(F.count("*"), F.sum(F.hash("node", "root").cast("bigint"))).first())
        if sums(small) == sums(edges):
            break
        edges = small
    nodes = edges.select("node", "root")
    return nodes.union(edges.select(F.col("root").alias("node"), "root").distinct())

"""Chat formatting of reply trees.

Messages reply to messages.  Every path from a root to a leaf is a possible conversation;
paths are ranked by the sum of their messages' scores and the best of each tree are
formatted.  Paths are found by iterated self-joins that double their reach each time, so a
tree of depth d needs about log2(d) joins; each step keeps one row per message, never a
pair of all messages.  The chosen leaves then climb the same steps back, which lists the
messages of a path without ever holding a path's texts before the last grouping.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import staged

TURN_START, ROLE_END, TURN_END = "### ", ": ", " </turn>\n"
# Character and its escape.  The first is the escape character itself.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("#", "\\2"), (":", "\\3"))


def escaped(text: Column) -> Column:
    """Text in which no control string of the template can occur; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, code in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for plain, code in reversed(ESCAPES):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def formatted_paths(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """The best root-to-leaf paths of every tree, each as one conversation.

    ``messages`` has ``tree``, ``node`` (unique in its tree), ``parent`` (null at a root),
    ``role``, ``text`` and ``score``.  A parent that is not in the tree counts as none.
    Messages on a cycle of replies have no root and belong to no path.  Null roles and
    texts are empty, a null score is 0, a null tree is a tree like any other.  Equal sums
    rank by the leaf's node.  No messages give no rows.

    Returns ``tree``, ``leaf``, ``path_rank``, ``path_score``, ``formatted`` and ``loss_spans``:
    start and end (code points, end exclusive) of each assistant text in ``formatted``.
    """
    nodes = staged(
        messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")),
        "chat-nodes",
    )
    known = nodes.select(F.col("tree").alias("k_tree"), F.col("node").alias("k_node"))
    met = F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("parent") == F.col("k_node"))
    step = first = staged(
        nodes.join(known, met, "left").select("tree", "node", F.col("k_node").alias("above"), F.col("score").alias("total")),
        "chat-step",
    )
    # steps[k]: each message with the one 2^k replies above it and the scores passed.  Messages
    # that have none so far above are at their root; they wait in ``done`` with their sums.
    steps, done = [], []
    longest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        done.append(step.where(F.col("above").isNull()))
        step = step.where(F.col("above").isNotNull())
        if 2 ** len(steps) > longest or step.isEmpty():
            break
        steps.append(step)
        upper = step
        for part in done:
            upper = upper.union(part)
        upper = upper.select(
            F.col("tree").alias("u_tree"), F.col("node").alias("u_node"), F.col("above").alias("u_above"), F.col("total").alias("u_total")
        )
        met = F.col("tree").eqNullSafe(F.col("u_tree")) & (F.col("above") == F.col("u_node"))
        step = staged(
            step.join(upper, met).select(
                "tree", "node", F.col("u_above").alias("above"), (F.col("total") + F.col("u_total")).alias("total")
            ),
            "chat-step",
        )
    finished = done[0]
    for part in done[1:]:
        finished = finished.union(part)

    replied = first.select(F.col("tree").alias("r_tree"), F.col("above").alias("r_node")).where(F.col("r_node").isNotNull())
    leaf = F.col("tree").eqNullSafe(F.col("r_tree")) & (F.col("node") == F.col("r_node"))
    best_first = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = (
        finished.join(replied, leaf, "left_anti").withColumn("path_rank", F.row_number().over(best_first))
        .where(F.col("path_rank") <= paths_per_tree)
        .select("tree", F.col("node").alias("leaf"), "path_rank", F.col("total").alias("path_score"), "node", F.lit(0).cast("bigint").alias("up"))
    )
    for k in reversed(range(len(steps))):
        upper = steps[k].select(F.col("tree").alias("u_tree"), F.col("node").alias("u_node"), F.col("above").alias("u_above"))
        met = F.col("tree").eqNullSafe(F.col("u_tree")) & (F.col("node") == F.col("u_node"))
        both = F.when(
            F.col("u_above").isNull(), F.array(F.struct("node", "up"))
        ).otherwise(F.array(F.struct("node", "up"), F.struct(F.col("u_above").alias("node"), (F.col("up") + 2**k).alias("up"))))
        chosen = chosen.join(upper, met, "left").select("tree", "leaf", "path_rank", "path_score", F.inline(both))

    body = messages.select(F.col("tree").alias("m_tree"), F.col("node").alias("m_node"), "role", "text")
    met = F.col("tree").eqNullSafe(F.col("m_tree")) & (F.col("node") == F.col("m_node"))
    path = ["tree", "leaf", "path_rank", "path_score"]
    head = F.concat(F.lit(TURN_START), escaped(F.col("role")), F.lit(ROLE_END))
    in_order = Window.partitionBy(*path).orderBy(F.desc("up"))
    starts = F.sum(F.char_length("head") + F.char_length("said") + len(TURN_END)).over(
        in_order.rowsBetween(Window.unboundedPreceding, -1)
    )
    turns = (
        chosen.join(body, met)
        .select(*path, "up", head.alias("head"), escaped(F.col("text")).alias("said"), (F.col("role") == "assistant").alias("learnt"))
        .withColumn("start", F.coalesce(starts, F.lit(0)) + F.char_length("head"))
    )
    span = F.struct(F.col("start").cast("bigint").alias("start"), (F.col("start") + F.char_length("said")).cast("bigint").alias("end"))
    return turns.groupBy(*path).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), F.concat("head", "said", F.lit(TURN_END)).alias("turn")))),
                lambda x: x["turn"],
            ),
            "",
        ).alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("learnt"), span))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.split(formatted, TURN_END.replace("\n", r"\n"))
    body = lambda turn: F.substr(turn, F.lit(len(TURN_START) + 1))
    role = lambda turn: F.substring_index(body(turn), ROLE_END, 1)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda turn: F.struct(
            unescaped(role(turn)).alias("role"),
            unescaped(F.substr(body(turn), F.char_length(role(turn)) + len(ROLE_END) + 1)).alias("text"),
        ),
    )


def read_masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    pieces = F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(pieces, "")


def linear_messages(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of ``formatted_paths`` from conversations without branches: each row replies
    to the row before it.  Rows of a conversation are ordered by turn (null first), equal
    turns by role and text; repeated rows stay as turns of their own."""
    frame = rows.select(
        F.col(f"`{conv_id}`").alias("tree"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text")
    )
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return (
        frame.withColumn("node", F.row_number().over(order).cast("bigint"))
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
        .withColumn("score", F.lit(0.0))
        .drop("turn")
    )

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat

SCHEMA = "tree bigint, node bigint, parent bigint, role string, text string, score double"


def brute_paths(rows):
    """tree -> (leaf, score, messages) of the best root-to-leaf path."""
    best = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        replied = {r[2] for r in own.values()}
        for node in own:
            if node in replied:
                continue
            path, at, seen = [], node, set()
            while at in own and at not in seen:
                seen.add(at)
                path.append(own[at])
                at = own[at][2]
            if at in seen:
                continue
            rank = (-sum(r[5] or 0.0 for r in path), node)
            if tree not in best or rank < best[tree][0]:
                best[tree] = (rank, node, path[::-1])
    return {t: (leaf, path) for t, (_, leaf, path) in best.items()}


def test_best_path_of_random_trees(spark):
    rng, rows = random.Random(5), []
    for tree in [*range(12), None]:
        for node in range(rng.randint(1, 25)):
            parent = rng.choice([None, 999, *range(node)]) if node else None
            if node and rng.random() < 0.7:
                parent = node - 1
            rows.append((tree, node, parent, rng.choice(["user", "assistant", None]), rng.choice(["a", "", None, "<#:\\0"]), rng.choice([None, 1.0, -0.5, 2.0])))
    out = chat.formatted_paths(spark.createDataFrame(rows, SCHEMA)).select(
        "tree", "leaf", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_masked(F.col("formatted"), F.col("loss_spans")).alias("masked")
    )
    want = brute_paths(rows)
    got = {r["tree"]: r for r in out.collect()}
    assert got.keys() == want.keys()
    for tree, (leaf, path) in want.items():
        assert got[tree]["leaf"] == leaf
        assert [tuple(t) for t in got[tree]["turns"]] == [(r[3] or "", r[4] or "") for r in path]
        assert got[tree]["masked"] == "".join(r[4] or "" for r in path if r[3] == "assistant")


def test_several_paths_and_cycles(spark):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "a", 1.0), (1, 2, 0, "assistant", "b", 2.0),
            (1, 7, 8, "user", "x", 9.0), (1, 8, 7, "user", "y", 9.0), (1, 9, 8, "user", "z", 9.0)]
    out = chat.formatted_paths(spark.createDataFrame(rows, SCHEMA), paths_per_tree=5).orderBy("path_rank").collect()
    assert [(r["leaf"], r["path_score"]) for r in out] == [(2, 2.0), (1, 1.0)]
    assert out[0]["formatted"] == "### user: q </turn>\n### assistant: b </turn>\n"
    start, end = out[0]["loss_spans"][0]
    assert out[0]["formatted"][start:end] == "b"


def test_long_chain(spark):
    n = 300
    rows = [(None, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 0.0) for i in range(n)]
    out = chat.formatted_paths(spark.createDataFrame(rows, SCHEMA)).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [t["text"] for t in out["t"]] == [f"t{i}" for i in range(n)]


def test_control_strings_come_back(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\\\0\\1", "#<:\\", " </turn>\n", "", "é\U0001f600<"]
    rows = [(1, i, i - 1 if i else None, ":" + t, t, 0.0) for i, t in enumerate(hard)]
    out = chat.formatted_paths(spark.createDataFrame(rows, SCHEMA))
    got = out.select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [tuple(x) for x in got] == [(":" + t, t) for t in hard]


def test_rows_without_branches(table_of, spark):
    rows = [(5, 1, "assistant", "a"), (5, 0, "user", "q"), (5, 1, "assistant", "a"), (5, None, None, None), (None, 0, "user", "n")]
    messages = chat.linear_messages(table_of(rows, "conv_id bigint, turn bigint, role string, text string"))
    out = {r["tree"]: r for r in chat.formatted_paths(messages).collect()}
    assert out[5]["formatted"] == "### :  </turn>\n### user: q </turn>\n### assistant: a </turn>\n### assistant: a </turn>\n"
    assert out[None]["formatted"] == "### user: n </turn>\n"
    assert chat.formatted_paths(messages.limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_hard_conversation_of_the_query(spark, folder):
    from ledgerloom.llm.queries import op5_chat_formatting

    row = op5_chat_formatting(spark, folder).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    said = f"user\n{text}\nassistant\n{text}\n"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
    assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()

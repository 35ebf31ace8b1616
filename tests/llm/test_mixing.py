from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing

DOCS = "doc_id bigint, text string, source string"


def targets_of(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Reshare by hand: deal out by weight, stop at the caps, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = set(), share * sum(sizes.values())
    while len(full) < len(order):
        rest = left - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over
    return {s: most * sizes[s] for s in order}


def test_word_count_is_the_number_of_runs(spark):
    texts = ["", " ", "a", " a  b\n", "\u00a0a \u00a0", "a\x0bb\x0cc\td\re", "\x1ca \x1c", None, "x " * 5000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in frame.orderBy("i").select(mixing.word_count(F.col("t"))).collect()]
    import re

    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_bounds(spark, seed):
    rng = random.Random(seed)
    docs = [(i, "w " * rng.choice([0, 1, 3, 10, 40]), rng.choice(["b", "a", "B", None, "é", "big", "big", "big"])) for i in range(1500)]
    items = mixing.sized_items(spark.createDataFrame(docs, DOCS))
    rows = mixing.spread(mixing.mixed(items, block=20)).collect()
    assert len(rows) == len(docs)
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for row in rows:
        sizes[row["source"]] += row["size"]
        taken[row["source"]] += row["copies"] * row["size"]
        most[row["source"]] = max(most[row["source"]], row["size"])
        assert 0 <= row["copies"] <= 2
    want = targets_of(sizes)
    for row in rows:
        assert row["target"] == pytest.approx(want[row["source"]]) and row["source_size"] == sizes[row["source"]]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 4 * most[source]
    again = mixing.spread(mixing.mixed(items.repartition(3), block=20)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_every_document_keeps_its_expected_copies(spark):
    """Over many sources that are alike, each document's mean number of copies is the rate."""
    docs = [(s * 10 + i, "w " * (i + 1), f"s{s:03d}") for s in range(600) for i in range(4)]
    rows = mixing.spread(mixing.mixed(mixing.sized_items(spark.createDataFrame(docs, DOCS)))).collect()
    by = defaultdict(list)
    for r in rows:
        by[(round(r["target"], 6), r["size"])].append(r["copies"])
    assert len(by) == 12  # a rate for each weight, times four sizes
    for (target, _), copies in by.items():
        assert sum(copies) / len(copies) == pytest.approx(target / 10, abs=0.12)


def test_nulls_repeats_and_nothing(table_of, spark):
    same = [(7, "a b", "s")] * 5
    docs = [*same, (None, None, None), (None, "a", None), (None, "a", None), (8, "", "t"), (9, "c", "t")]
    rows = mixing.spread(mixing.mixed(mixing.sized_items(table_of(docs, DOCS)))).collect()
    assert len(rows) == len(docs)
    copies = [r["copies"] for r in rows if r["doc_id"] == 7]
    assert len(copies) == 5 and max(copies) - min(copies) <= 1
    empty = mixing.mixed(mixing.sized_items(table_of(docs, DOCS).limit(0)))
    assert empty.count() == 0
    assert mixing.mixed(mixing.sized_items(table_of([(1, None, "x")], DOCS))).first()["copies"] == 0


def test_many_repeats_unfold_in_steps(spark, monkeypatch):
    docs = [(1, "a b", "s")] * 23 + [(2, "c", "s")] * 4 + [(3, "d e f", "t")]
    items = mixing.mixed(mixing.sized_items(spark.createDataFrame(docs, DOCS)))
    found = lambda: sorted((r["doc_id"], r["copies"]) for r in mixing.spread(items).collect())
    whole = found()
    monkeypatch.setattr(mixing, "REPEATS_AT_A_TIME", 5)
    assert found() == whole and len(whole) == len(docs)


def test_no_python_in_the_plan(spark, plan_of):
    docs = spark.createDataFrame([(1, "a", "s")], DOCS)
    plan = plan_of(mixing.spread(mixing.mixed(mixing.sized_items(docs))))
    assert not any(word in plan for word in ("ArrowEval", "MapInArrow", "MapInPandas", "BatchEvalPython"))

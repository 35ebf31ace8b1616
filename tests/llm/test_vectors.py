from __future__ import annotations

import numpy as np
import pytest

from ledgerloom.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, least=0.93):
    """vec_id -> (links, smallest reachable id), ids unique."""
    usable = [
        (i, np.array(v, float), lab)
        for i, v, lab in rows
        if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    near = {i: set() for i, _, _ in rows}
    for k, (i, v, lab) in enumerate(usable):
        for j, w, other in usable[:k]:
            if lab == other and len(v) == len(w):
                v1, w1 = v / np.abs(v).max(), w / np.abs(w).max()
                if v1 @ w1 / (np.linalg.norm(v1) * np.linalg.norm(w1)) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(near[i]), min(seen))
    return out


def clustered(n, groups, seed, dim=24):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    for size, spread in groups:
        center, lab = rng.normal(size=dim), int(rng.integers(0, 3))
        for _ in range(size):
            rows.append((len(rows), (center + spread * rng.normal(size=dim)).astype(np.float32).tolist(), lab))
    return rows


def check(spark, rows, least_recall=0.98):
    want = brute(rows)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    links = sum(n for n, _ in want.values())
    assert all(got[i]["n_links"] <= want[i][0] for i in want)
    assert sum(r["n_links"] for r in got.values()) >= least_recall * links > 0
    wrong = sum(got[i]["component_id"] != want[i][1] for i in want)
    assert wrong <= 0.01 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_links_and_groups(spark):
    check(spark, clustered(300, [(2, 0.05), (5, 0.1), (60, 0.1), (30, 0.2)], 1))


def test_many_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 60)
    monkeypatch.setattr(vectors, "PART", 40)
    check(spark, clustered(500, [(2, 0.05)] * 8 + [(150, 0.08), (90, 0.15)], 2))


def test_more_overlap_where_recall_is_low(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 40)
    monkeypatch.setattr(vectors, "OVERLAPS", (1, 8))
    seen, real = [], vectors._recall
    monkeypatch.setattr(vectors, "_recall", lambda *a: seen.append(real(*a)) or seen[-1])
    check(spark, clustered(400, [(40, 0.25), (30, 0.22), (20, 0.2)], 3), 0.9)
    assert seen


def test_unusable_equal_and_odd_vectors(spark, table_of):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0] * 3, 0), (8, [1.0, None, 2.0], 0),
            (9, [float("nan"), 1.0, 1.0], 0), (10, [float("inf"), 1.0, 1.0], 0), (11, [], 0), (12, [1.0, 2.0], 0), (13, [1e-38, 2e-38, 3e-38], 0)]
    out = vectors.near_duplicates(table_of(rows, SCHEMA))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}
    assert got[1] == (3, 1, True) and got[13][1] == 1


def test_repeated_rows_null_ids_and_nothing(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in vectors.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False)], key=repr)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_small_graphs_reach_everything(n):
    x = vectors.unit(np.random.default_rng(n).normal(size=(n, 4)))
    lists = vectors.padded(vectors.with_links_back(vectors.robust_pruned(x)))
    found = vectors.searched(x, lists, x, -1.1)
    assert found.all()


def exact(spark, rows):
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def grouped(groups, size, seed, dim=24, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    vecs = np.repeat(centers, size, axis=0) + spread * rng.normal(size=(groups * size, dim))
    return [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(vecs)]


def test_many_small_groups_in_a_shard_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 5000)
    exact(spark, grouped(300, 6, 5))


def test_every_pair_is_counted_across_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 100)
    monkeypatch.setattr(vectors, "PART", 40)
    monkeypatch.setattr(vectors, "OVERLAPS", (1000,))
    exact(spark, grouped(100, 3, 12) + [(1000 + i, v, 0) for i, v, _ in grouped(1, 150, 13, spread=0.1)])


def test_low_recall_is_never_returned(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 20)
    monkeypatch.setattr(vectors, "OVERLAPS", (1,))
    monkeypatch.setattr(vectors, "_recall", lambda *_: 0.0)
    exact(spark, grouped(30, 6, 14, spread=0.2))


def test_audit_sees_rare_links_and_every_vector_alike(spark):
    rng = np.random.default_rng(15)
    rows = [(i, rng.normal(size=24).tolist(), 0, 24, 1) for i in range(1500)]
    rows += [(2000 + i, (np.array(rows[0][1]) + 0.01 * i).tolist(), 0, 24, 1) for i in range(2)]
    classes = spark.createDataFrame(rows, "cls bigint, embedding array<double>, label int, dim int, times bigint").cache()
    none = spark.createDataFrame([], "cls bigint, n bigint")
    assert vectors._recall(classes, none, 0.93) == 0.0
    pairs = [(i, [float(x) for x in np.eye(12)[i // 2]], 0, 12, 1000 if i < 2 else 1) for i in range(24)]
    dense = spark.createDataFrame(pairs, "cls bigint, embedding array<double>, label int, dim int, times bigint")
    some = spark.createDataFrame([(0, 1000), (1, 1000)], "cls bigint, n bigint")
    assert vectors._recall(dense, some, 0.93) == 2 / 24

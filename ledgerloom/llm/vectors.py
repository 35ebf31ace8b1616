"""Near-duplicate vectors by robust-pruned graphs on overlapping shards.

Vectors with the same label are dealt to overlapping shards around centers.  Each shard builds a
robust-pruned graph of its vectors; a vector's adjacency lists from all its shards are united.  Every
vector is then searched for in the graphs of its shards: a greedy walk from the medoid, and
from all that is in range, the vector's own neighbours to begin with, everything around it
until nothing more is in range.  Cosines are taken in double precision.

Two audits guard the links.  A shard compares some of its vectors with all of them, and where the search
missed a link it compares all pairs instead.  Over all shards, the recall of the links is
measured against brute force on a sample, and the vectors are dealt again with more
overlap if it is low, in the end all in one shard.

Equal vectors are one class.  A shard with more vectors than a task should hold is cut into
parts with a graph each, and any two parts search each other, so a dense group needs no single
large task and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ledgerloom.llm.common import staged
from ledgerloom.llm.components import roots

LEAST_COSINE = 0.93
SHARD = 1000  # vectors aimed at in a shard
PART = 2000  # most vectors of a part or a block of queries
MOST_CENTERS = 8192  # of all labels together
SAMPLE_PER_CENTER = 4
DEGREE = 24
BACKWARD = 4  # nearest neighbours that link back, so that every vector can be reached
SPREAD = 1.2  # robust pruning: how much nearer a neighbour must be to rule one out
BEAM = 16  # the walk; what is in range is followed without limit
CHECKED = 128  # vectors of a part compared with all of another, to audit the search
OVERLAPS = (2, 4, 8)
AUDITED = 200  # vectors with a true link
MOST_ASKED = 8192  # vectors compared with all at a time
LEAST_RECALL = 0.95
PAIRS_AT_A_TIME = 400_000
CELLS_AT_A_TIME = 4_000_000  # of vectors by centers


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision and without under- or overflow."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def robust_pruned(x: np.ndarray, degree: int = DEGREE, spread: float = SPREAD) -> np.ndarray:
    """Neighbour lists (-1 where shorter) of all rows, each chosen from all others."""
    n = len(x)
    far = (2 - 2 * (x @ x.T)).astype(np.float32)  # squared distances
    left = far.copy()
    np.fill_diagonal(left, np.inf)
    lists = np.full((n, min(degree, max(1, n - 1))), -1, np.int64)
    rows = np.arange(n)
    for k in range(lists.shape[1]):
        pick = left.argmin(axis=1)
        live = np.isfinite(left[rows, pick])
        if not live.any():
            break
        lists[live, k] = pick[live]
        # rule out what is nearer to the pick than to the row, by the factor
        ruled = spread * spread * far[pick] <= far
        left[ruled & live[:, None]] = np.inf
        left[rows, pick] = np.inf
    return lists


def with_links_back(lists: np.ndarray) -> list[np.ndarray]:
    """The lists without padding; each row also stands in the lists of its nearest picks."""
    n = len(lists)
    near = lists[:, :BACKWARD]
    rows = np.broadcast_to(np.arange(n)[:, None], lists.shape)
    back = np.broadcast_to(np.arange(n)[:, None], near.shape)
    ends = np.concatenate([np.stack([rows[lists >= 0], lists[lists >= 0]], 1), np.stack([near[near >= 0], back[near >= 0]], 1)])
    ends = np.unique(ends, axis=0)
    return np.split(ends[:, 1], np.searchsorted(ends[:, 0], np.arange(1, n)))


def padded(lists: list[np.ndarray]) -> np.ndarray:
    """Ragged lists as a matrix, filled up with -1."""
    out = np.full((len(lists), max([1, *map(len, lists)])), -1, np.int64)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out


def searched(
    x: np.ndarray, lists: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM, near_by: tuple[np.ndarray, np.ndarray] | None = None
) -> np.ndarray:
    """Boolean query x row: the rows in range that a search from the medoid finds, and from the pairs
    (query, row) in ``near_by``."""
    n, m = len(x), len(queries)
    seen = np.zeros((m, n), bool)
    found = np.zeros((m, n), bool)
    opened = np.zeros((m, n), bool)
    start = int((x @ x.mean(axis=0)).argmax())
    width = min(beam, n)
    ids = np.full((m, width), -1, np.int64)
    near = np.full((m, width), -np.inf)
    rows = np.arange(m)
    ids[:, 0], near[:, 0] = start, queries @ x[start]
    seen[:, start] = True
    found[:, start] = near[:, 0] >= least
    if near_by is not None:
        who, to = near_by
        seen[who, to] = True
        found[who, to] |= np.einsum("ij,ij->i", queries[who], x[to]) >= least
    while True:  # greedy walk, all queries at once
        closed = (ids < 0) | opened[rows[:, None], ids]
        best = np.where(closed, -np.inf, near).argmax(axis=1)
        go = rows[~closed[rows, best]]
        if not len(go):
            break
        at = ids[go, best[go]]
        opened[go, at] = True
        next_ = lists[at]
        new = (next_ >= 0) & ~seen[go[:, None], next_]
        who = np.repeat(go, new.sum(axis=1))
        to = next_[new]
        cosine = np.einsum("ij,ij->i", queries[who], x[to])
        seen[who, to] = True
        found[who, to] = cosine >= least
        value = np.full(next_.shape, -np.inf)
        value[new] = cosine
        all_ids = np.concatenate([ids[go], np.where(new, next_, -1)], axis=1)
        all_near = np.concatenate([near[go], value], axis=1)
        top = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        ids[go] = np.take_along_axis(all_ids, top, 1)
        near[go] = np.take_along_axis(all_near, top, 1)
    while True:  # everything around what is in range
        who, at = np.nonzero(found & ~opened)
        if not len(who):
            break
        opened[who, at] = True
        step = max(1, PAIRS_AT_A_TIME // lists.shape[1])
        for k in range(0, len(who), step):
            next_ = lists[at[k : k + step]]
            by = np.broadcast_to(who[k : k + step, None], next_.shape)
            new = (next_ >= 0) & ~seen[by, next_]
            pair = np.unique(by[new] * n + next_[new])
            some, to = pair // n, pair % n
            seen[some, to] = True
            found[some, to] = np.einsum("ij,ij->i", queries[some], x[to]) >= least
    return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _neighbours(table: pa.Table) -> pa.Table:
    """The adjacency lists of one part's graph."""
    ids = table.column("cls").to_numpy()
    lists = with_links_back(robust_pruned(unit(_matrix(table.column("embedding")))))
    return pa.table({"cls": pa.array(ids), "neighbours": pa.array([ids[own] for own in lists], pa.list_(pa.int64()))})


class _Part:
    """The vectors of one part in the order of their ids, with their adjacency lists."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("cls")
        self.x, self.ids = unit(_matrix(table.column("embedding"))), table.column("cls").to_numpy()
        self.times = table.column("times").to_numpy()
        shards = table.column("shards").to_pylist()
        width = max(map(len, shards))
        self.shards = np.array([s + [-1] * (width - len(s)) for s in shards])
        lists = table.column("neighbours").to_pylist()
        self.owner = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
        self.neighbour = np.array([i for own in lists for i in own], np.int64)

    def placed_in(self, other: _Part) -> tuple[np.ndarray, np.ndarray]:
        """(own number, number in the other part) of all adjacencies that end there."""
        at = np.searchsorted(other.ids, self.neighbour).clip(0, len(other.ids) - 1)
        there = other.ids[at] == self.neighbour
        return self.owner[there], at[there]

    def lists(self) -> np.ndarray:
        owner, at = self.placed_in(self)
        cuts = np.searchsorted(owner, np.arange(1, len(self.ids)))
        return padded(np.split(at, cuts))


def _missed(found: np.ndarray, x: np.ndarray, y: np.ndarray, least: float, same: bool) -> bool:
    """Whether an even choice of the rows has a link that was not found."""
    some = np.unique(np.linspace(0, len(x) - 1, CHECKED).astype(np.int64))
    true = x[some] @ y.T >= least
    if same:
        true[np.arange(len(some)), some] = False
    return bool((true & ~found[some]).any())


def found_between(one: _Part, other: _Part, least: float) -> np.ndarray:
    """Boolean matrix of the links between two parts, or within one if they are the same."""
    if one is other:
        own = np.arange(len(one.ids))
        found = searched(one.x, one.lists(), one.x, least, near_by=(own, own))
        found |= found.T
        np.fill_diagonal(found, False)
    else:
        found = searched(one.x, one.lists(), other.x, least, near_by=other.placed_in(one)).T
        found |= searched(other.x, other.lists(), one.x, least, near_by=one.placed_in(other))
    same = one is other
    if _missed(found, one.x, other.x, least, same) or (not same and _missed(found.T, other.x, one.x, least, same)):
        found = one.x @ other.x.T >= least
        if same:
            found |= found.T
            np.fill_diagonal(found, False)
    return found


def _search_with(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Links between the two parts of a meeting, or within one: per vector the vectors linked (where
        this shard is the first that both are in) and a vector to be grouped with."""
        numbers = table.column("part").to_numpy()
        first = _Part(table.filter(pa.array(numbers == numbers.min())))
        other = first if (numbers == numbers[0]).all() else _Part(table.filter(pa.array(numbers == numbers.max())))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        none = pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if low != high and first is other:
            return none  # the other part has no vectors
        here = table.column("shard")[0].as_py()
        who, at = np.nonzero(found_between(first, other, least))
        # A pair that meets in several shards is found in each and counted in the first of them.
        counted = np.ones(len(who), bool)
        for a in range(first.shards.shape[1]):
            own = first.shards[who, a]
            for b in range(other.shards.shape[1]):
                counted &= ~((own >= 0) & (own < here) & (own == other.shards[at, b]))
        links: dict[int, int] = {}
        sums = [(first, who, other.times[at])] + ([(other, at, first.times[who])] if other is not first else [])
        for part, rows, times in sums:
            n = np.bincount(rows[counted], weights=times[counted], minlength=len(part.ids)).astype(np.int64)
            links |= {int(part.ids[i]): int(n[i]) for i in np.flatnonzero(n)}
        # Enough edges to join every group: each vector with the smallest one it is joined with here.
        ids = np.unique(np.concatenate([first.ids, other.ids]))
        u, v = np.searchsorted(ids, first.ids[who]), np.searchsorted(ids, other.ids[at])
        root = np.arange(len(ids))
        while True:
            smaller = root.copy()
            np.minimum.at(smaller, u, root[v])
            np.minimum.at(smaller, v, root[u])
            smaller = smaller[smaller]
            if (smaller == root).all():
                break
            root = smaller
        ends = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table(
            {
                "cls": pa.array([*links, *ids[ends].tolist()], pa.int64()),
                "links": pa.array([*links.values(), *[0] * len(ends)], pa.int64()),
                "other": pa.array([*[None] * len(links), *ids[root[ends]].tolist()], pa.int64()),
            }
        )

    return run


def _usable(embedding: Column, label: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _centers(classes: DataFrame) -> dict[tuple, np.ndarray]:
    """Centers of the labels that need more than one shard, far from each other, chosen on the
    driver from a sample of at most SAMPLE_PER_CENTER * MOST_CENTERS vectors in all."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = F.least(F.ceil(F.col("n") / SHARD), F.floor(F.col("n") * float(MOST_CENTERS) / float(max(1, total))))
    sizes = sizes.withColumn("k", share.cast("int")).where("k >= 2").select(
        F.col("label").alias("s_label"), F.col("dim").alias("s_dim"), "k"
    )
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64("embedding"), "cls")
    picked = (
        classes.join(sizes, (F.col("label") == F.col("s_label")) & (F.col("dim") == F.col("s_dim")))
        .withColumn("_at", F.row_number().over(order))
        .where((F.col("_at") <= F.col("k") * SAMPLE_PER_CENTER) & (F.col("_at") <= MOST_CENTERS * SAMPLE_PER_CENTER))
        .select("label", "dim", "k", "embedding", "_at")
        .toArrow()
    )
    out: dict[tuple, np.ndarray] = {}
    keys = list(zip(picked.column("label").to_pylist(), picked.column("dim").to_pylist()))
    for key in sorted(set(keys)):
        own = picked.filter(pa.array([k == key for k in keys])).sort_by("_at")
        x = unit(_matrix(own.column("embedding")))
        chosen, near = [0], x @ x[0]
        while len(chosen) < own.column("k")[0].as_py():
            at = int(near.argmin())
            if near[at] > LEAST_COSINE:
                break
            chosen.append(at)
            near = np.maximum(near, x @ x[at])
        out[key] = x[chosen]
    return out


def _nearest(cosines: np.ndarray, most: int) -> list[list[int]]:
    """Numbers of the ``most`` largest in each row, the largest first, ties by number."""
    if most < cosines.shape[1]:
        kept = np.sort(np.argpartition(-cosines, most - 1, axis=1)[:, :most], axis=1)
    else:
        kept = np.broadcast_to(np.arange(cosines.shape[1]), cosines.shape)
    order = np.argsort(-np.take_along_axis(cosines, kept, 1), axis=1, kind="stable")
    return np.take_along_axis(kept, order, 1).tolist()


def _sharded(classes: DataFrame, centers: dict, overlap: int) -> DataFrame:
    """Add ``shards``: the numbers of the ``overlap`` nearest centers, the nearest first."""
    share = classes.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        known = share.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table.column("label").to_pylist(), table.column("dim").to_pylist()))
            shards: list[list[int]] = [[0]] * len(keys)
            for key in set(keys) & known.keys():
                own = [i for i, k in enumerate(keys) if k == key]
                x, step = unit(_matrix(table.column("embedding").take(pa.array(own)))), max(1, CELLS_AT_A_TIME // len(known[key]))
                for start in range(0, len(own), step):
                    for i, row in zip(own[start : start + step], _nearest(x[start : start + step] @ known[key].T, overlap)):
                        shards[i] = row
            yield batch.append_column("shards", pa.array(shards, pa.list_(pa.int32())))

    schema = StructType([*classes.schema.fields, StructField("shards", ArrayType(IntegerType()))])
    return classes.mapInArrow(run, schema)


def _linked(classes: DataFrame, centers: dict, overlap: int, least: float) -> DataFrame:
    """Rows (cls, links, other) from all shards."""
    members = _sharded(classes, centers, overlap).withColumn("shard", F.explode("shards"))
    keys = ["label", "dim", "shard"]
    members = staged(members, "vector-shards")
    counts = members.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).select(
        *[F.col(k).alias(f"c_{k}") for k in keys], "parts"
    )
    met = F.lit(True)
    for k in keys:
        met = met & (F.col(k) == F.col(f"c_{k}"))
    members = members.join(counts, met).drop("c_label", "c_dim", "c_shard")
    members = members.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    members = staged(members, "vector-parts")
    lists = members.groupBy(*keys, "part").applyInArrow(_neighbours, "cls bigint, neighbours array<bigint>")
    # A vector has a list from each of its shards, of which there are ``overlap`` at most.
    united = lists.groupBy(F.col("cls").alias("of_cls")).agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    members = staged(members.join(united, F.col("cls") == F.col("of_cls")).drop("of_cls"), "vector-graph")
    # Each part meets every part of its shard, itself included.
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    meetings = F.transform(every, lambda b: F.struct(F.least("part", b).alias("low"), F.greatest("part", b).alias("high")))
    placed = members.select(*keys, "cls", "times", "embedding", "shards", "neighbours", "part", F.inline(meetings))
    return placed.groupBy(*keys, "low", "high").applyInArrow(_search_with(least), "cls bigint, links bigint, other bigint")


def _recall(classes: DataFrame, links: DataFrame, least: float) -> float:
    """The smaller of two shares of true links that were found, over all links and on average
    per vector.  Vectors are drawn until AUDITED of them have a true link or all were drawn,
    and compared with all; groups of many copies weigh no more than others in the second."""
    order = F.xxhash64("cls", F.lit(4))
    got = total = shares = seen = 0
    size, last = AUDITED, None
    while seen < AUDITED:
        rest = classes if last is None else classes.where(order > last)
        asked = rest.withColumn("at", order).orderBy("at").limit(size)
        rows = asked.join(links, "cls", "left").select("at", "cls", "label", "dim", "embedding", F.coalesce("n", F.lit(0)).alias("n")).toArrow()
        if not rows.num_rows:
            break
        last = max(rows.column("at").to_pylist())
        want = _true_links(classes, rows, least)
        for c, n in zip(rows.column("cls").to_pylist(), rows.column("n").to_pylist()):
            if want.get(c):
                hit = min(n, want[c])
                got, total, shares, seen = got + hit, total + want[c], shares + hit / want[c], seen + 1
        if rows.num_rows < size:
            break
        size = min(2 * size, MOST_ASKED)
    return min(got / total, shares / seen) if seen else 1.0


def _true_links(classes: DataFrame, rows: pa.Table, least: float) -> dict[int, int]:
    """Number of true links of each of the given vectors, compared with all."""
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(rows.column("label").to_pylist(), rows.column("dim").to_pylist())):
        groups.setdefault(key, []).append(i)
    ids = rows.column("cls").to_numpy()
    packed = {k: (ids[own], unit(_matrix(rows.column("embedding").take(pa.array(own))))) for k, own in groups.items()}
    share = classes.sparkSession.sparkContext.broadcast(packed)

    def count(batches):
        known, sums = share.value, {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table.column("label").to_pylist(), table.column("dim").to_pylist()))
            own_ids, times = table.column("cls").to_numpy(), table.column("times").to_numpy()
            for key in set(keys) & known.keys():
                own = np.array([i for i, k in enumerate(keys) if k == key])
                asked_ids, x = known[key]
                y = unit(_matrix(table.column("embedding").take(pa.array(own))))
                for k in range(0, len(x), AUDITED):
                    some = asked_ids[k : k + AUDITED]
                    hit = (x[k : k + AUDITED] @ y.T >= least) & (some[:, None] != own_ids[own][None, :])
                    for q, n in zip(some.tolist(), (hit @ times[own]).tolist()):
                        sums[q] = sums.get(q, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], ["cls", "n"])

    true = classes.select("label", "dim", "cls", "times", "embedding").mapInArrow(count, "cls bigint, n bigint")
    return {r["cls"]: r["n"] for r in true.groupBy("cls").agg(F.sum("n").alias("n")).collect()}


def _overlaps(widest: int) -> Iterator[int]:
    """OVERLAPS, then twice as much each time, and at last as many as there are centers."""
    last = 1
    for last in OVERLAPS:
        if last < widest:
            yield last
    while 2 * last < widest:
        last *= 2
        yield last
    yield widest


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    least: float = LEAST_COSINE,
) -> DataFrame:
    """Links and group of every vector: ``vec_id``, ``n_links`` (other vectors of the same label
    with cosine of at least ``least``), ``component_id`` (smallest id reachable by links, itself
    included) and ``kept`` (whether it has that id).

    Vectors without label, null, empty or zero ones, and those with a null or non-finite
    component link with nothing; nor do vectors of different length.  Repeated rows are
    vectors of their own and link with each other.  A row without id counts as a link, is
    passed over when the smallest id is taken, and is not kept.  No rows give no rows.
    """
    base = vectors.select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), F.col(f"`{label}`").alias("label")
    )
    base = base.withColumn("_k1", F.xxhash64("label", "embedding")).withColumn("_k2", F.hash("embedding", "label"))
    usable = base.where(_usable(F.col("embedding"), F.col("label")))
    classes = staged(
        usable.groupBy("_k1", "_k2")
        .agg(F.count("*").alias("times"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "vector-classes",
    )
    slim = classes.select("cls", "label", "dim", "times", "embedding")
    centers = _centers(slim)
    widest = max([1, *map(len, centers.values())])
    for overlap in _overlaps(widest):
        # With all centers as overlap every vector would be in every shard: one shard is the same.
        rows = staged(_linked(slim, centers if overlap < widest else {}, min(overlap, widest), least), "vector-links")
        links = rows.where("links > 0").groupBy("cls").agg(F.sum("links").alias("n"))
        if overlap == widest or _recall(slim, links, least) >= LEAST_RECALL:
            break
    linked = roots(rows.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = (
        classes.select("_k1", "_k2", "cls", "times", "first_id")
        .join(links, "cls", "left")
        .join(linked, F.col("cls") == F.col("node"), "left")
        .select("_k1", "_k2", "first_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    )
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "s_root")
    groups = named.join(smallest, F.col("root") == F.col("s_root")).select(
        F.col("_k1").alias("g1"), F.col("_k2").alias("g2"), "n_links", "component_id"
    )
    alone = ~_usable(F.col("embedding"), F.col("label"))
    met = (F.col("_k1") == F.col("g1")) & (F.col("_k2") == F.col("g2")) & ~alone
    out = base.join(groups, met, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("g1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

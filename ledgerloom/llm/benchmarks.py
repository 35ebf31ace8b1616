"""Benchmark decontamination: SimHash of item-sized windows.

A benchmark item of n words is looked for in all windows of n words of every document.  A
window's SimHash over its word shingles is looked up in a multi-index: the 64 bits are cut
into more than half as many blocks as the radius has bits, so two fingerprints within the
radius differ by at most one bit in some block, and no item within the radius is missed.
What is found is compared exactly by weighted shingles (every shingle weighs as often as it
occurs).  Windows without a single shingle of an item of their size have similarity zero and
are not hashed; that leaves out nothing that could be found.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import over_texts

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 10  # 2 * BLOCKS > RADIUS: some block differs by one bit at most
ITEM_CHARS_AT_A_TIME = 16_000_000
PAIRS_AT_A_TIME = 2_000_000  # of windows and items
WINDOWS_AT_A_TIME = 20_000

# Bytes that are no part of a word become spaces; bytes from 0x80 on belong to words.
_CLEAN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 2)


def shingle_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of each run of ``length`` words, from the words' hashes."""
    n = len(hashes) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(length):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def window_prints(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the ``length`` shingles from each start on."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    stops = np.minimum(starts + length, len(shingles))
    ones = sums[stops] - sums[starts]
    major = ones * 2 > (stops - starts)[:, None]
    return np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()


class MultiIndex:
    """Fingerprints of items, found by any that is within RADIUS bits.

    For each block of bits the items stand in the order of their value there, so those with a
    value, or with one that differs by a bit, are looked up as slices.  Queries are taken a few at a
    time, so that memory does not grow with queries times items.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for lo, hi in zip(_EDGES, _EDGES[1:]):
            width = int(hi - lo)
            own = (prints >> np.uint64(lo) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(own, kind="stable").astype(np.int32)
            starts = np.searchsorted(own[order], np.arange((1 << width) + 1))
            changes = np.array([0, *[1 << b for b in range(width)]])
            self.tables.append((order, starts, changes))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, item number) of all pairs within the radius."""
        step = max(1, PAIRS_AT_A_TIME // max(1, len(self.prints)))
        parts = [self._search(queries[at : at + step], at) for at in range(0, len(queries), step)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in parts]), np.concatenate([i for _, i in parts])

    def _search(self, queries: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        near_pairs = []
        n = len(self.prints)
        for (lo, hi), (order, starts, changes) in zip(zip(_EDGES, _EDGES[1:]), self.tables):
            value = (queries >> np.uint64(lo) & np.uint64((1 << int(hi - lo)) - 1)).astype(np.int64)
            looked = value[:, None] ^ changes[None, :]
            sizes = (starts[looked + 1] - starts[looked]).ravel()
            query = np.repeat(np.repeat(np.arange(len(queries)), len(changes)), sizes)
            item = order[np.repeat(starts[looked].ravel() - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(query))]
            near = np.bitwise_count(queries[query] ^ self.prints[item]) <= RADIUS
            near_pairs.append(query[near] * n + item[near])
        pairs = np.unique(np.concatenate(near_pairs))
        return pairs // n + first, pairs % n


class SizedItems:
    """Items of one number of words: their fingerprints and weighted shingles, as arrays."""

    def __init__(self, n: int, items: list[tuple[int | None, np.ndarray]]):
        self.n, self.length = n, min(SHINGLE_WORDS, n)
        self.ids = [item_id for item_id, _ in items]
        shingles = [shingle_hashes(hashes, self.length) for _, hashes in items]
        self.index = MultiIndex(np.concatenate([window_prints(s, np.array([0]), len(s)) for s in shingles]))
        bags = [np.unique(s, return_counts=True) for s in shingles]
        self.bag_starts = np.cumsum([0, *[len(k) for k, _ in bags]])
        self.bag_keys = np.concatenate([k for k, _ in bags])
        self.bag_counts = np.concatenate([c for _, c in bags]).astype(np.int32)
        # shingle -> items that hold it
        owner = np.repeat(np.arange(len(bags), dtype=np.int32), np.diff(self.bag_starts))
        order = np.argsort(self.bag_keys, kind="stable")
        self.holders = owner[order]
        self.keys, self.holder_starts = np.unique(self.bag_keys[order], return_index=True)
        self.holder_starts = np.append(self.holder_starts, len(order))

    def similarities(self, shingles: np.ndarray, starts: np.ndarray, items: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pairs (window start, item) that reach LEAST_SIMILARITY, and how similar they are."""
        # At most the places in the window that hold a shingle of the item are shared.
        at = np.searchsorted(self.keys, shingles)
        at[at == len(self.keys)] = 0
        place = np.flatnonzero(self.keys[at] == shingles)
        held = self.holder_starts[at[place] + 1] - self.holder_starts[at[place]]
        holder = self.holders[np.repeat(self.holder_starts[at[place]] - (np.cumsum(held) - held), held) + np.arange(held.sum())]
        wide = len(shingles) + size + 1
        marks = np.sort(holder.astype(np.int64) * wide + np.repeat(place, held))
        most = np.searchsorted(marks, items * wide + starts + size) - np.searchsorted(marks, items * wide + starts)
        own = np.minimum(size, len(shingles) - starts)
        both = own + (self.n - self.length + 1)
        good = np.flatnonzero(most >= np.ceil(LEAST_SIMILARITY / (1 + LEAST_SIMILARITY) * both - 1e-9))
        found = np.zeros(len(good))
        for k, pair in enumerate(good.tolist()):
            start, item = int(starts[pair]), int(items[pair])
            keys, counts = np.unique(shingles[start : start + size], return_counts=True)
            bag = slice(int(self.bag_starts[item]), int(self.bag_starts[item + 1]))
            own_keys, own_counts = self.bag_keys[bag], self.bag_counts[bag]
            where = np.searchsorted(own_keys, keys).clip(0, len(own_keys) - 1)
            shared = int(np.minimum(counts, own_counts[where])[own_keys[where] == keys].sum())
            found[k] = shared / (int(both[pair]) - shared)
        real = found >= LEAST_SIMILARITY
        return good[real], found[real]


class ItemIndex:
    """Items of one block, by number of words."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.words: dict[bytes, int] = {}
        sized = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            for word in words:
                self.words.setdefault(word, len(self.words) + 1)
            if words:
                sized[len(words)].append((item_id, np.array([_word_hash(w) for w in words], np.uint64)))
        self.hash_of = np.array([0, *map(_word_hash, self.words)], np.uint64)
        self.sized = {n: SizedItems(n, own) for n, own in sorted(sized.items())}
        # shingle length -> (shingles, and for each the sizes of the items that hold it)
        self.postings = {}
        for length in sorted({own.length for own in self.sized.values()}):
            some = [own for own in self.sized.values() if own.length == length]
            keys = np.concatenate([own.keys for own in some])
            sizes = np.repeat(np.array([own.n for own in some], np.int32), [len(own.keys) for own in some])
            order = np.argsort(keys, kind="stable")
            unique, starts = np.unique(keys[order], return_index=True)
            self.postings[length] = unique, np.append(starts, len(order)), sizes[order]

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, float]]:
        """(item, first word, words, similarity) of each item found, at its best window."""
        words = words_of(text)
        if not words or not self.words:
            return []
        known = np.array([self.words.get(w, 0) for w in words], np.int64)
        found: dict[int | None, tuple[float, int, int]] = {}
        hashes = None
        for length, (keys, starts, sizes) in self.postings.items():
            if len(words) < length:
                continue
            whole = np.lib.stride_tricks.sliding_window_view(known > 0, length).all(axis=1)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            value = np.zeros(len(at), np.uint64)
            for k in range(length):
                value = (value ^ self.hash_of[known[at + k]]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            place = np.searchsorted(keys, value)
            place[place == len(keys)] = 0
            hit = keys[place] == value
            if not hit.any():
                continue
            if hashes is None:
                hashes = np.array([_word_hash(w) for w in words], np.uint64)
            at, place = at[hit], place[hit]
            many = starts[place + 1] - starts[place]
            size = sizes[np.repeat(starts[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            around = np.repeat(at, many)
            for n in np.unique(size).tolist():
                self._windows(self.sized[n], around[size == n], hashes, found)
        return [(i, start, n, s) for i, (s, start, n) in sorted(found.items(), key=lambda x: (x[0] is None, x[0] or 0))]

    def _windows(self, items: SizedItems, places: np.ndarray, hashes: np.ndarray, found: dict) -> None:
        """Look at all windows of the items' size that hold a shingle at one of the places."""
        n, size = items.n, items.n - items.length + 1
        last = max(0, len(hashes) - n)
        # windows from ``place - size + 1`` to ``place`` hold the shingle there
        change = np.zeros(last + 2, np.int64)
        np.add.at(change, (places - size + 1).clip(0, last), 1)
        np.add.at(change, places.clip(0, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        # runs of starts, so that only the words around the places are hashed
        cuts = np.flatnonzero(np.diff(starts) > n) + 1
        for run in np.split(starts, cuts):
            for at in range(0, len(run), WINDOWS_AT_A_TIME):
                self._run(items, run[at : at + WINDOWS_AT_A_TIME], hashes, found)

    def _run(self, items: SizedItems, run: np.ndarray, hashes: np.ndarray, found: dict) -> None:
        size, low = items.n - items.length + 1, int(run[0])
        shingles = shingle_hashes(hashes[low : int(run[-1]) + items.n], items.length)
        prints, same = np.unique(window_prints(shingles, run - low, size), return_inverse=True)
        query, item = items.index.search(prints)
        # equal windows were looked up once; every one of them is compared
        order = np.argsort(same, kind="stable")
        begins = np.searchsorted(same[order], np.arange(len(prints) + 1))
        many = begins[query + 1] - begins[query]
        window = order[np.repeat(begins[query] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        starts, item = run[window] - low, np.repeat(item, many)
        for pair, similarity in zip(*(x.tolist() for x in items.similarities(shingles, starts, item, size))):
            start, item_id = int(starts[pair]) + low, items.ids[item[pair]]
            old = found.get(item_id)
            if old is None or (similarity, -start) > (old[0], -old[1]):
                found[item_id] = (similarity, start, items.n)


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text"):
    """The benchmark in blocks of bounded size, each as an index.  Null texts, and texts without a
    word, can't be found."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = total // ITEM_CHARS_AT_A_TIME + 1
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        yield ItemIndex([(r["i"], r["t"]) for r in own.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, carried: list[str], text: str = "text") -> DataFrame:
    """Every benchmark item found in every whole document: the carried columns, ``item_id``,
    ``first_word`` (from 0), ``n_words`` and ``similarity`` of its best window.

    An item is found where a window of as many words reaches weighted shingle similarity
    0.8; items of fewer than five words must be met as a whole.  A document shorter than an
    item is one window.  Null and empty texts hold nothing.  Repeated documents are each
    reported, repeated items once per id, and items without id together with a null one.  An empty benchmark or no documents: no rows.  The
    benchmark is a query set: it goes to the tasks in blocks of bounded size, one pass over
    the documents per block.
    """
    found = None
    for index in item_blocks(benchmark):
        part = _searched(docs, index, carried, text).where("found IS NOT NULL")
        found = part if found is None else found.union(part)
    return found.select(*[F.col(f"`{c}`") for c in carried], F.inline("found"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no benchmark item is found, as they are."""
    kept = docs
    for index in item_blocks(benchmark):
        kept = _searched(kept, index, docs.columns, text).where("found IS NULL").drop("found")
    return kept


def _searched(docs: DataFrame, index: ItemIndex, carried: list[str], text: str) -> DataFrame:
    share = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        known = share.value
        names = ("item_id", "first_word", "n_words", "similarity")
        packed = lambda found: [dict(zip(names, row)) for row in found] or None
        return lambda texts: [[packed(known.matches(t)) for t in texts]]

    schema = "found array<struct<item_id:bigint,first_word:bigint,n_words:bigint,similarity:double>>"
    return over_texts(docs, carried, text, schema, make)

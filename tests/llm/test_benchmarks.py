from __future__ import annotations

import random
from collections import Counter

import numpy as np

from ledgerloom.llm import benchmarks

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def brute(text, items):
    words, found = benchmarks.words_of(text), {}
    for item_id, item in items:
        own = benchmarks.words_of(item)
        if item_id is None or not own or not words:
            continue
        k, n = min(5, len(own)), len(own)
        bag = Counter(tuple(own[i : i + k]) for i in range(n - k + 1))
        for start in range(max(1, len(words) - n + 1)):
            window = words[start : start + n]
            other = Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1))
            shared = sum((bag & other).values())
            similarity = shared / (bag.total() + other.total() - shared)
            if similarity >= 0.8 and (item_id not in found or (similarity, -start) > (found[item_id][0], -found[item_id][1])):
                found[item_id] = (similarity, start)
    return found


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice("klmnop")
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 70)))) for i in range(40)]
    items += [(40, "Two words"), (41, "one"), (42, ""), (43, None), (44, items[3][1]), (45, "rep rep rep rep rep rep rep rep")]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.randint(0, 150))]
        if d % 3:
            item = (rng.choice(items)[1] or "x").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = word()
            item = [w.upper() + "," if rng.random() < 0.2 else w for w in item]
            cut = rng.choice([0, 0, 0, 1, 4])
            at = rng.randint(0, len(words))
            words[at:at] = item[cut:]
        docs.append((d, " ".join(words)))
    docs += [(200, None), (201, ""), (202, items[5][1]), (202, items[5][1]), (None, items[6][1]), (203, "rep " * 12), (204, "two words")]
    return docs, items


def test_matches_against_brute_force(table_of, spark):
    docs, items = corpus()
    out = benchmarks.contaminated(table_of(docs, DOCS), table_of(items, ITEMS), ["doc_id"]).collect()
    got = sorted(((r["doc_id"], r["item_id"], r["first_word"], round(r["similarity"], 9)) for r in out), key=repr)
    want = sorted(((d, i, a, round(s, 9)) for d, t in docs for i, (s, a) in brute(t, items).items()), key=repr)
    assert got == want and len(want) > 40


def test_items_in_blocks(table_of, monkeypatch):
    docs, items = corpus(7)
    whole = benchmarks.contaminated(table_of(docs, DOCS), table_of(items, ITEMS), ["doc_id"]).collect()
    monkeypatch.setattr(benchmarks, "ITEM_CHARS_AT_A_TIME", 2500)
    parts = benchmarks.contaminated(table_of(docs, DOCS), table_of(items, ITEMS), ["doc_id"]).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, parts))
    kept = benchmarks.uncontaminated(table_of(docs, DOCS, extra=False), table_of(items, ITEMS))
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(t or "" for d, t in docs if not brute(t, items))


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**63, 50, dtype=np.uint64)
    queries = []
    for p in prints.tolist():
        for bits in (0, 5, 19, 20, 30):
            q = p
            for b in rng.choice(64, bits, replace=False).tolist():
                q ^= 1 << b
            queries.append(q)
    queries = np.array(queries, np.uint64)
    got = set(zip(*(x.tolist() for x in benchmarks.MultiIndex(prints).search(queries))))
    want = {(q, p) for q in range(len(queries)) for p in range(50) if int(queries[q] ^ prints[p]).bit_count() <= benchmarks.RADIUS}
    assert got == want


def test_nothing_to_find(table_of):
    docs, items = corpus()
    assert benchmarks.contaminated(table_of(docs, DOCS), table_of(items, ITEMS).limit(0), ["doc_id"]).count() == 0
    assert benchmarks.contaminated(table_of(docs, DOCS).limit(0), table_of(items, ITEMS), ["doc_id"]).count() == 0
    assert benchmarks.uncontaminated(table_of(docs, DOCS), table_of(items, ITEMS).limit(0)).count() == len(docs)


def test_items_without_id_are_found_too(table_of, spark):
    docs = [(1, "a b c d e f g h"), (2, "p q r s t u v w"), (3, "nothing of it")]
    items = [(None, "A b c d e f g h"), (None, "p q r s t u v w"), (7, "p q r s t u v w")]
    got = benchmarks.contaminated(table_of(docs, DOCS), table_of(items, ITEMS), ["doc_id"]).select("doc_id", "item_id", "similarity").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, None, 1.0), (2, None, 1.0), (2, 7, 1.0)], key=repr)
    kept = benchmarks.uncontaminated(table_of(docs, DOCS, extra=False), table_of(items, ITEMS))
    assert [r["doc_id"] for r in kept.collect()] == [3]


def test_a_long_document_made_of_items_needs_little_memory():
    import time
    import tracemalloc

    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice("klmnop") + rng.choice("aeiou")
    items = [(i, " ".join(word() for _ in range(50))) for i in range(5700)]
    index = benchmarks.ItemIndex(items)
    chosen = rng.sample(range(5700), 240)
    text = " ".join(items[i][1] for i in chosen)
    began = time.time()
    plain = index.matches(text)
    took = time.time() - began
    tracemalloc.start()
    index.matches(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = {i: (start, s) for i, start, _, s in plain}
    assert {i: (50 * at, 1.0) for at, i in enumerate(chosen)}.items() <= found.items()
    assert peak < 300 * 2**20 and took < 60, (peak, took)


def test_every_similar_window_is_a_candidate():
    """Recall of the fingerprints: windows of a weighted similarity of 0.8 lie within the radius."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    near = total = 0
    for _ in range(300):
        n = rng.randint(20, 90)
        item = [rng.choice(words) for _ in range(n)]
        other = list(item)
        for _ in range(rng.randint(0, max(1, n // 40))):
            other[rng.randrange(n)] = rng.choice(words)
        hashes = [np.array([benchmarks._word_hash(w.encode()) for w in ws], np.uint64) for ws in (item, other)]
        a, b = (benchmarks.shingle_hashes(h, 5) for h in hashes)
        x, y = Counter(a.tolist()), Counter(b.tolist())
        if (x & y).total() / (x | y).total() >= 0.8:
            total += 1
            prints = [benchmarks.window_prints(s, np.array([0]), len(s)) for s in (a, b)]
            near += len(benchmarks.MultiIndex(prints[0]).search(prints[1])[0])
    assert total > 100 and near / total > 0.99

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from ledgerloom.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string"
END = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")


def pieces_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [WORD.findall(p) for p in END.split(low)]


def brute(rows, least=30, top=2000):
    by_lang = defaultdict(list)
    for _, text, lang in rows:
        by_lang["und" if lang is None else lang] += pieces_of(text)
    out = set()
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for i in range(len(p)) for k in range(1, 5) if i + k <= len(p))
        n = sum(len(p) for p in pieces)
        candidates = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        kept = []
        for w, a in candidates.items():
            holders = [b for v, b in candidates.items() if len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
            if not any(100 * b >= 80 * a for b in holders):
                cut = min(range(1, len(w)), key=lambda k: (2000000 * a // (f[w[:k]] + f[w[k:]]), k))
                left, right = f[w[:cut]], f[w[cut:]]
                kept.append((-(2000000 * a // (left + right)), -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def invented(n, seed):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "c", "é", "the", "of", "x-y", "日本", "Q"]
    rows = []
    for i in range(n):
        text = "".join(str(w) + str(rng.choice([" ", "\t ", ". ", "\n", ",", "  "], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05])) for w in rng.choice(words, rng.integers(0, 25)))
        rows.append((i, text, [None, "en", "de", "und"][rng.integers(0, 4)]))
    return rows


def check(spark, rows, **limits):
    got = collocations.mined(spark.createDataFrame(rows, SCHEMA), **limits)
    assert [t for c, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    want = brute(rows, limits.get("least", 30), limits.get("top", 2000))
    assert set(found) == want
    return want


def test_against_brute_force(spark):
    assert len(check(spark, invented(600, 1))) > 50


def test_a_full_bit_set_changes_nothing(spark):
    """With a few bits every pair shares its bit with a frequent one, and no window is padded early."""
    rows = invented(200, 2)
    check(spark, rows, least=5, bits=3)
    check(spark, rows, least=5, bits=24)
    check(spark, rows, least=2, top=4)


def test_overlaps_ties_and_repeats(spark):
    rows = [(1, "a a a a a a", "en")] * 20 + [(2, "b c d e. b c. B\tC  d", "en")] * 30 + [(3, "x y", "de")] * 30 + [(4, "x y", "de")] * 29
    check(spark, rows)
    check(spark, rows, least=1)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "...", "en"), (4, "\x00 \x01\x1f \x7f", "en"), (5, "one", ""), (None, " \t\n", "de")]
    check(spark, rows * 31)
    check(spark, rows, least=1)


def test_clashing_columns_and_nothing(spark, table_of):
    rows = invented(150, 3)
    frame = table_of(rows, SCHEMA).selectExpr("*", "'p' AS phrase", "'w' AS w1", "1 AS a", "2 AS l", "3 AS k", "4 AS f", "5 AS pair")
    assert {tuple(r) for r in collocations.mined(frame, least=5).collect()} == brute(rows, 5)
    assert collocations.mined(frame.limit(0)).count() == 0


def test_a_hot_pair_and_a_hot_language(spark):
    rows = [(i, f"of the u{i} of the v{i % 40} w{i % 40}", "en" if i % 10 else "de") for i in range(900)]
    check(spark, rows)


@settings(max_examples=150)
@given(st.lists(st.text(st.sampled_from("aB é.,\n\t日;"), max_size=20), max_size=6), st.integers(1, 12))
def test_blocks_keep_words_and_pieces(texts, most):
    array = pa.array(["skipped", *texts], pa.string()).slice(1)
    found = defaultdict(list)
    for block, (data, begins, first) in enumerate(collocations.blocks(array, most)):
        words, piece, row = collocations.words_of(data, begins)
        for word, p, r in zip(words.to_pylist(), piece, row):
            found[first + r, block, p].append(word)
    by_row = defaultdict(list)
    for (row, _, _), words in found.items():
        by_row[row].append(words)
    assert [by_row[i] for i in range(len(texts))] == [[p for p in pieces_of(t) if p] for t in texts]


def test_a_pair_that_is_frequent_is_never_missed(spark):
    rows = invented(200, 4)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, 'und') lang", "text")
    for bits in (3, 10, 27):
        bit_set = collocations.frequent(frame, (), 20, bits)
        assert len(bit_set) == max(1, 2**bits // 8)
        for lang in ("en", "de", "und"):
            pieces = [p for _, t, la in rows if (la or "und") == lang for p in pieces_of(t)]
            pairs = Counter(x for p in pieces for x in zip(p, p[1:]))
            for (a, b), n in pairs.items():
                words = pa.array([a, b]).dictionary_encode()
                pair, _ = collocations.pair_hashes(words, np.zeros(2, np.int64), np.repeat(collocations._hashes([lang]), 2))
                inside = bool(collocations._in(bit_set, pair, bits)[0])
                assert inside or n < 20
                assert bits < 27 or inside == (n >= 20)

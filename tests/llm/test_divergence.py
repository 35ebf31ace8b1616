from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from ledgerloom.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", Counter(terms_of(text))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, c in own for t in c)
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, c in own:
            counts[source].update({t: n for t, n in c.items() if t in kept})
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            over = [(far(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(order, 1)}
    return out


def invented(n, seed, sources=5):
    rng = np.random.default_rng(seed)
    words = ["the", "Of", "été", "straße", "x", "Ünï", "don't", "a-b", "日本語", "q1q", "THE"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(0, 30)))
        rows.append((i, text, rng.choice(["en", "de", None]), f"s{rng.integers(0, sources)}" if rng.random() < 0.9 else None))
    return [(i, t, lang and str(lang), s) for i, t, lang, s in rows]


def check(spark, rows, **limits):
    got = divergence.audited(spark.createDataFrame(rows, SCHEMA), **limits)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, limits.get("least_documents", 10), limits.get("top", 10))


def test_against_brute_force(spark):
    check(spark, invented(300, 1))


def test_many_shards(spark):
    check(spark, invented(300, 2), cells=20, top=3)


def test_odd_rows(spark):
    rows = [(i, t, lang, s) for i, (t, lang, s) in enumerate(
        [("a b", "x", "s1")] * 10 + [(None, "x", "s2"), ("", "x", None), ("a", None, None), ("!", "y", "s1"), ("c", "y", "s2"), ("same", "z", "s")] + [("same", "z", "s")] * 12)]
    check(spark, rows)
    check(spark, rows + rows, least_documents=1)


def test_hot_group_and_term(spark):
    rows = [(i, "hot " * (i % 7) + f"own{chr(97 + i % 5)}", "en", "big" if i % 3 else f"s{i % 4}") for i in range(400)]
    check(spark, rows, cells=8)


def test_clashing_columns_null_ids_and_nothing(spark, table_of):
    rows = [(None, t, lang, s) for _, t, lang, s in invented(60, 3)]
    frame = table_of(rows, SCHEMA).selectExpr("*", "'t' AS term", "1 AS total", "'i' AS item", "2 AS value", "3 AS rank", "4 AS leads")
    assert {tuple(r) for r in divergence.audited(frame).collect()} == brute(rows)
    assert divergence.audited(frame.limit(0)).count() == 0


def test_long_texts_are_counted_whole(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_CHARS", 50)
    texts = ["word " * 40 + "Été" * 30, "", "word other"]
    out = divergence.count_terms(pa.array(["l"] * 3), pa.array(["a", "a", "b"]), pa.array(texts))
    found = {(r["source"], r["term"]): (r["n"], r["docs"]) for r in out.to_pylist()}
    want = Counter((s, t) for s, x in zip("aab", texts) for t in terms_of(x))
    assert {k: n for k, (n, _) in found.items() if k[1]} == want
    assert found["a", "word"] == (40, 1) and found["b", "word"] == (1, 1) and found["a", ""] == (0, 0)


@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=5), st.integers(1, 10**6))
def test_shares_are_exact(counts, kept):
    total = sum(counts) + 5
    got = divergence.shares(np.array(counts), np.array(total), kept)
    assert got.tolist() == [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in counts]


@settings(max_examples=200)
@given(st.text(max_size=60))
def test_terms_are_those_of_the_pattern(text):
    text = text.encode("utf-8", "ignore").decode()
    found, terms = divergence._term_counts(pa.array([text], pa.string()))
    assert dict(zip(terms.take(found["code"].combine_chunks()).to_pylist(), found["n"].to_pylist())) == Counter(terms_of(text))


@pytest.mark.parametrize("most", [1, 3, 10])
def test_pieces_cut_no_term(most):
    text = "ab, cdé fgh  " * 9 + "x"
    cut = divergence.pieces(text, most)
    assert "".join(cut) == text
    assert [t for c in cut for t in terms_of(c)] == terms_of(text)

from __future__ import annotations

import random
import re

import pytest

from ledgerloom.llm import licenses

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string"
COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        want = phrase.split()
        for at in range(len(words)):
            if words[at : at + len(want)] == want:
                places.append(at)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def prose(rng, n):
    return " ".join(rng.choice(["thing", "of", "the", "work", "é", "under", "licensed", "x1"]) for _ in range(n))


def test_scan_against_brute_force(table_of):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randint(0, 60))) for i in range(120)]
    parts = ["MIT License", "mit, LICENSE!", "Apache-License", "general public license", "general\npublic", "license"]
    docs += [(200 + i, " ".join(rng.choice([*parts, prose(rng, 3)]) for _ in range(8))) for i in range(60)]
    docs += [(400, None), (401, ""), (402, "ÀMIT License"), (403, "mit license " * 500), (None, "mit license"), (1, docs[1][1])]
    rows = licenses.scanned(table_of(docs, SCHEMA, extra=False), ["doc_id"]).select(*COLUMNS).collect()
    got = sorted((tuple(r)[:6] for r in rows), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in docs), key=repr)
    for row in rows:
        base, all_ = (set(row[c].split(",")) - {""} for c in ("base_labels", "labels"))
        assert base <= all_ and 0 <= row["score"] <= 1


@pytest.mark.parametrize("label, text", [(t[0], t[1]) for t in licenses.TEMPLATES])
def test_every_template_is_found_and_needs_its_phrases(table_of, label, text):
    rng = random.Random(1)
    clean = [(i, prose(rng, 30)) for i in range(60)]
    words = text.split()
    docs = [*clean, (100, prose(rng, 20) + " " + text + ". " + prose(rng, 20)), (101, " ".join(reversed(words)))]
    rows = {r["doc_id"]: r for r in licenses.scanned(table_of(docs, SCHEMA, extra=False), ["doc_id"]).collect()}
    assert label in rows[100]["labels"].split(",") and rows[100]["score"] == 1.0
    assert rows[101]["labels"] == ""  # the same words in another order
    assert all(rows[i]["labels"] == "" for i in range(60))


def test_no_documents(table_of):
    assert licenses.scanned(table_of([(1, "a")], SCHEMA, extra=False).limit(0), ["doc_id"]).count() == 0


def test_document_frequencies(table_of):
    index = licenses.Index()
    found, n = licenses.document_frequencies(table_of([(1, "MIT mit"), (2, None), (3, "the mit")], SCHEMA), "text", index)
    assert n == 3 and found == {b"mit": 2, b"the": 1}


LONG = [(label, text) for label, text, _ in licenses.TEMPLATES if label in ("bsd", "isc", "mpl", "cc-by", "unlicense") or text.startswith("Permission")]


@pytest.mark.parametrize("label, text", LONG)
def test_a_licence_in_a_third_of_the_documents_and_in_the_only_one(table_of, label, text):
    rng = random.Random(2)
    docs = [(i, f"{prose(rng, 10)} {text} {prose(rng, 10)}" if i % 3 == 0 else prose(rng, 30)) for i in range(30)]
    rows = {r["doc_id"]: r for r in licenses.scanned(table_of(docs, SCHEMA, extra=False), ["doc_id"]).collect()}
    assert all((rows[i]["labels"], rows[i]["score"]) == ((label, 1.0) if i % 3 == 0 else ("", 0.0)) for i, _ in docs)
    (row,) = licenses.scanned(table_of(docs[:1], SCHEMA, extra=False), ["doc_id"]).collect()
    assert (row["labels"], row["score"]) == (label, 1.0)


def test_a_file_with_all_templates_has_all_labels(table_of):
    rng = random.Random(4)
    notices = " ".join(f"{text}. {prose(rng, 40)}" for _, text, _ in licenses.TEMPLATES)
    docs = [(1, notices), (2, " ".join(t[1] for t in reversed(licenses.TEMPLATES))), *((10 + i, prose(rng, 30)) for i in range(60))]
    # a long text with every licence word in passing and one licence
    words = sorted({w for _, text, _ in licenses.TEMPLATES for w in text.split()})
    bsd = next(text for label, text, _ in licenses.TEMPLATES if label == "bsd")
    docs.append((3, " ".join(rng.choice(words) for _ in range(3000)) + " " + bsd))
    rows = {r["doc_id"]: r for r in licenses.scanned(table_of(docs, SCHEMA, extra=False), ["doc_id"]).collect()}
    every = sorted({t[0] for t in licenses.TEMPLATES})
    assert [rows[i]["labels"].split(",") for i in (1, 2)] == [every, every]
    assert "bsd" in rows[3]["labels"].split(",") and rows[3]["score"] == 1.0

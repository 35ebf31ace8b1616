"""Licence scan with a positional index of rare words.

The index lists, for each word of the licence templates, where it stands in which template.
A template's words with the highest inverse document frequency are looked up in the file first,
and its other words if those do not find all of it; a word at place p of the file and place q of
the template puts the template's start at p - q, and starts on which several words agree are
candidates.  A candidate counts if enough of the
template's words stand at their places (give or take two words) and all of its mandatory
phrases stand within its reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import over_texts

# Phrase and label of the plain scan.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Label, template, mandatory phrases.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee"),
    ),
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
)
RARE_WORDS = 16  # of a template, looked up in the index before the others
LEAST_AGREEING = 2
LEAST_SHARE = 0.6
SLACK = 2

# Bytes outside words become spaces and A-Z lower case; a word is a run of the rest.
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_CLEAN).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: np.ndarray  # numbers of its words
    phrases: tuple[tuple[int, ...], ...]


class Index:
    """Postings of the templates' words, and how rare the words are."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES):
        self.number: dict[bytes, int] = {}
        of = lambda text: [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text.encode())]
        self.base = [(tuple(of(phrase)), label) for phrase, label in phrases]
        self.templates = [Template(label, np.array(of(text)), tuple(tuple(of(p)) for p in must)) for label, text, must in templates]
        self.postings: dict[int, dict[int, np.ndarray]] = {}
        for at, template in enumerate(self.templates):
            for word in set(template.words.tolist()):
                self.postings.setdefault(word, {})[at] = np.flatnonzero(template.words == word)
        self.needed = [frozenset(w for phrase in t.phrases for w in phrase) for t in self.templates]
        self.weigh({}, 0)

    def weigh(self, frequencies: dict[bytes, int], documents: int) -> None:
        """Keep the inverse document frequency of every word, however common it is."""
        self.idf = {word: float(np.log((documents + 1) / (frequencies.get(word, 0) + 1))) for word in self.number}
        names = [None, *self.number]
        self.ranked = [sorted(set(t.words.tolist()), key=lambda w: (-self.idf[names[w]], w)) for t in self.templates]

    def scan(self, text: bytes | None):
        """n_words, n_base, first_word, last_word, base_labels, labels, score of a file."""
        words = words_of(text)
        number = self.number
        known = {number[w] for w in number.keys() & set(words)}
        # Without the words of a template's mandatory phrases it can't be found.
        if not any(need <= known for need in self.needed) and not any(known.issuperset(phrase) for phrase, _ in self.base):
            return len(words), 0, None, None, "", "", 0.0
        ids = np.array([number.get(w, 0) for w in words], np.int32)
        places, base = [], set()
        for phrase, label in self.base:
            at = _stands(ids, phrase)
            if len(at):
                places.append(at)
                base.add(label)
        found = self._aligned(ids, known)
        score = max([0.5 * bool(base), *found.values()])
        starts = np.concatenate(places) if places else np.zeros(0, np.int64)
        return (
            len(words),
            len(starts),
            int(starts.min()) if len(starts) else None,
            int(starts.max()) if len(starts) else None,
            ",".join(sorted(base)),
            ",".join(sorted(base | found.keys())),
            score,
        )

    def _aligned(self, ids: np.ndarray, known: set[int]) -> dict[str, float]:
        """label -> largest share of a template's words at their places.  The rarest words of a
        template are looked up first and all of them unless those find the whole template."""
        found: dict[str, float] = {}
        for at, template in enumerate(self.templates):
            if not self.needed[at] <= known or found.get(template.label) == 1.0:
                continue
            phrases = [(len(phrase), _stands(ids, phrase)) for phrase in template.phrases]
            if not all(len(places) for _, places in phrases):
                continue
            words = [w for w in self.ranked[at] if w in known]
            for some in (words[:RARE_WORDS], words):
                share = self._best(ids, at, some, phrases)
                if share == 1.0 or len(some) == len(words):
                    break
            if share > found.get(template.label, 0.0):
                found[template.label] = share
        return found

    def _best(self, ids: np.ndarray, at: int, words: list[int], phrases: list[tuple[int, np.ndarray]]) -> float:
        """Largest share of a template at the starts its words agree on, all phrases within reach; 0
        if it is less than LEAST_SHARE."""
        template, votes = self.templates[at], []
        for word in words:
            here = np.flatnonzero(ids == word)
            votes.append((here[:, None] - self.postings[word][at][None, :]).ravel())
        starts, agreeing = np.unique(np.concatenate(votes), return_counts=True)
        starts = starts[agreeing >= LEAST_AGREEING]
        for length, places in phrases:
            first = np.searchsorted(places, starts - SLACK)
            last = np.searchsorted(places, starts + len(template.words) + SLACK - length, "right")
            starts = starts[first < last]
        share = float(_shares(ids, starts, template.words).max(initial=0.0))
        return share if share >= LEAST_SHARE else 0.0


def _stands(ids: np.ndarray, phrase: tuple[int, ...]) -> np.ndarray:
    """Places where the words of a phrase stand one behind the other."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    fits = np.ones(n, bool)
    for k, word in enumerate(phrase):
        fits &= ids[k : k + n] == word
    return np.flatnonzero(fits)


def _shares(ids: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each start the share of the words that stand within SLACK of their places."""
    edge = len(words) + SLACK
    padded = np.concatenate([np.zeros(edge, ids.dtype), ids, np.zeros(edge, ids.dtype)])
    hits = np.zeros(len(starts))
    for j, word in enumerate(words.tolist()):
        there = np.zeros(len(starts), bool)
        for shift in range(-SLACK, SLACK + 1):
            there |= padded[np.clip(starts + j + shift + edge, 0, len(padded) - 1)] == word
        hits += there
    return hits / len(words)


def document_frequencies(docs: DataFrame, text: str, index: Index) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, over all documents, and their number.
    At most one row per word of the templates reaches the driver."""
    vocabulary = frozenset(index.number)
    column = F.col(f"`{text}`").alias("text")

    def count(batches):
        import pyarrow as pa

        sums: dict[bytes, int] = {}
        total = 0
        for batch in batches:
            total += batch.num_rows
            for value in batch.column(0).cast(pa.binary()):
                for word in vocabulary.intersection(words_of(value.as_py())):
                    sums[word] = sums.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(w.decode() for w in sums), None], pa.string()), pa.array([*sums.values(), total], pa.int64())],
            ["word", "n"],
        )

    rows = docs.select(column).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows if r["word"] is not None}
    return found, sum(r["n"] for r in rows if r["word"] is None)


def scanned(docs: DataFrame, carried: list[str], text: str = "text") -> DataFrame:
    """Licences of every whole document: the carried columns, ``n_words``, ``n_base`` (places of
    the plain phrases), ``first_word``, ``last_word`` (their smallest and largest start, else
    null), ``base_labels`` and ``labels`` (distinct, sorted, comma-joined; the second with
    those of the method) and ``score``: the largest share of a template found, at least 0.5
    where a plain phrase stands.

    A null or empty text has no words and no labels.  Repeated rows are scanned alike; no
    rows give no rows.
    """
    index = Index()
    index.weigh(*document_frequencies(docs, text, index))
    share = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        known = share.value
        return lambda texts: list(zip(*map(known.scan, texts)))

    schema = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return over_texts(docs, carried, text, schema, make, raw=True)

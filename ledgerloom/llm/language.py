"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, one row per n-gram bucket and one column per
language.  It is of bounded size, goes to the tasks with the function and scores texts in
numpy: a whole batch of texts is one array of code points, its n-grams are one array of
buckets, and a text's score is the sum of its buckets' rows.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import over_texts

BUCKETS = 2**15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
TEXTS_PER_LANGUAGE = 1500
LANGUAGES_AT_A_TIME = 100  # columns of a matrix, 26 MB
PIECE = 500_000  # code points scored at a time
UNKNOWN = "und"

_NOT_WORDS = re.compile(r"[\W\d_]+")


@cache
def _numerals() -> re.Pattern:
    """Runs of numerals that are no digits, such as fractions and Roman numbers: what re calls a word
    character beside letters (category L), digits and the underscore."""
    return re.compile(f"[{''.join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())}]+")


@dataclass(frozen=True)
class Model:
    """Log-probabilities of a block of languages; ``more`` has the other blocks."""

    languages: tuple[str, ...]
    log_p: np.ndarray  # BUCKETS x languages
    prior: np.ndarray
    more: tuple[Model, ...] = ()


def letters_only(text: str | None) -> str:
    """Lower-cased letters; everything between words is one space, also at both ends."""
    clean = _NOT_WORDS.sub(" ", (text or "").lower()).strip()
    if not clean.replace(" ", "a").isalpha():
        clean = _NOT_WORDS.sub(" ", _numerals().sub(" ", clean)).strip()
    return f" {clean} "


def gram_buckets(codes: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram starting at each code point."""
    mixed = (codes.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    found, value = [], np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        n = len(codes) - order + 1
        if n <= 0:
            break
        value = (value[:n] * np.uint32(16777619)) ^ mixed[order - 1 : order - 1 + n]
        if order in ORDERS:
            spread = (value ^ (value >> np.uint32(15))) * np.uint32(2246822519 + 2 * order)
            found.append((spread >> np.uint32(17)).astype(np.int32))
    return found


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(texts: list[str]):
    """Runs of texts of about PIECE code points, as (codes, text number of each code).  A
    longer text is cut; the cuts overlap so that no n-gram is lost, and the code points
    that only complete n-grams of the cut before belong to no text (-1)."""
    over = max(ORDERS) - 1
    held, owners, size = [], [], 0
    for at, text in enumerate(texts):
        for start in range(0, len(text), PIECE):
            part = _code_points(text[start : start + PIECE + over])
            owner = np.full(len(part), at, np.int32)
            owner[PIECE:] = -1
            if size and size + len(part) > PIECE:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, size = [], [], 0
            held.append(part)
            owners.append(owner)
            size += len(part)
    if size:
        yield np.concatenate(held), np.concatenate(owners)


def count_grams(texts: list[str | None]) -> np.ndarray:
    """Counts per bucket over all the texts."""
    counts = np.zeros(BUCKETS, np.int64)
    for codes, owner in _pieces([letters_only(t) for t in texts]):
        for buckets in gram_buckets(codes):
            counts += np.bincount(buckets[owner[: len(buckets)] >= 0], minlength=BUCKETS)
    return counts


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Best language of a block and its posterior probability among its languages."""
    best, raw, mass = block_scores(texts, model)
    names = [UNKNOWN if at is None else at for at in best]
    return names, [0.0 if at is None else float(np.exp(r - m)) for at, r, m in zip(best, raw, mass)]


def block_scores(texts: list[str | None], model: Model) -> tuple[list[str | None], list[float], list[float]]:
    """For each text the best language of a block (null without a letter), the logarithm of its score, and
    that of the sum of all the block's scores.

    N-grams that reach from one text into the next begin with a space at the end of a text; they are
    few and alike for all languages' texts, but they are left out, so a text's score depends
    on it alone."""
    clean = [letters_only(t) for t in texts]
    total = np.tile(model.prior, (len(texts), 1))
    for codes, owner in _pieces(clean):
        cut = np.flatnonzero(np.diff(owner)) + 1
        for order, buckets in zip(ORDERS, gram_buckets(codes)):
            own = owner[: len(buckets)].copy()
            if order > 1 and len(cut):
                # the last order - 1 positions of a text start n-grams that leave it
                leaving = (cut[:, None] - np.arange(1, order)[None, :]).ravel()
                leaving = leaving[(leaving >= 0) & (leaving < len(own))]
                after = owner[np.minimum(leaving + order - 1, len(owner) - 1)]
                own[leaving[(after != own[leaving]) & (after != -1)]] = -1
            good = own >= 0
            own, buckets = own[good], buckets[good]
            if not len(own):
                continue
            starts = np.flatnonzero(np.r_[True, np.diff(own) != 0])
            sums = np.add.reduceat(model.log_p[buckets], starts, axis=0)
            np.add.at(total, own[starts], sums)
    best = total.argmax(axis=1)
    high = total[np.arange(len(total)), best]
    mass = high + np.log(np.exp(total - high[:, None]).sum(axis=1))
    names = [model.languages[at] if text.strip() else None for text, at in zip(clean, best)]
    return names, high.tolist(), mass.tolist()


def fitted(labelled: DataFrame, draw: Column, texts_per_language: int = TEXTS_PER_LANGUAGE) -> Model | None:
    """Model from rows (text, lang); null if no row has both.

    About ``texts_per_language`` whole texts per language are learnt from: those whose ``draw``,
    a hash of the row, lies in the share of all hashes that gives so many, so the sample is
    a filter and no language is gathered to be ranked.  The priors count all rows.  The
    languages are learnt and later scored in blocks of LANGUAGES_AT_A_TIME, in the order of their
    names, so no matrix grows with their number.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    shares = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not shares:
        return None
    total = sum(r["n"] for r in shares)
    blocks = [
        _block(rows, draw, texts_per_language, shares[at : at + LANGUAGES_AT_A_TIME], total)
        for at in range(0, len(shares), LANGUAGES_AT_A_TIME)
    ]
    return replace(blocks[0], more=tuple(blocks[1:]))


def _block(rows: DataFrame, draw: Column, texts_per_language: int, shares: list, total: int) -> Model:
    """Model of the languages in ``shares`` (lang, n), of rows of ``total`` in all."""
    limits = [x for r in shares for x in (F.lit(r["lang"]), F.lit(min(1.0, texts_per_language / r["n"])))]
    drawn = F.pmod(draw, F.lit(2**32)) / F.lit(float(2**32))
    sample = rows.where(drawn < F.element_at(F.create_map(*limits), F.col("lang"))).select("lang", "text")

    def counts(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for lang in set(names):
                own = [texts[i].as_py() for i, name in enumerate(names) if name == lang]
                sums[lang] = sums.get(lang, 0) + count_grams(own)
        for lang, array in sums.items():
            at = np.flatnonzero(array)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(array[at], pa.int64())],
                ["lang", "bucket", "n"],
            )

    # At most LANGUAGES_AT_A_TIME x BUCKETS small rows; other languages have no share.
    found = (
        sample.mapInArrow(counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    languages = tuple(r["lang"] for r in shares)
    place = {lang: i for i, lang in enumerate(languages)}
    matrix = np.full((BUCKETS, len(languages)), SMOOTHING)
    column = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    matrix[found.column("bucket").to_numpy(), column] += found.column("n").to_numpy()
    n = np.array([r["n"] for r in shares], float)
    return Model(languages, np.log(matrix / matrix.sum(axis=0)), np.log(n / total))


def with_language(frame: DataFrame, carried: list[str], text: str, model: Model | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) for every whole text.

    A null text, or one without a letter, has no language: ``und`` and score 0, and so has
    every text if there is no model.  Equal scores go to the first language by name.
    """
    if model is None:
        return frame.select(*[F.col(f"`{c}`") for c in carried], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.more:
        share = frame.sparkSession.sparkContext.broadcast(model)

        def make():
            known = share.value
            return lambda texts: list(score_texts(texts, known))

        return over_texts(frame, carried, text, "lang_pred string, score double", make)
    rows = frame.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias("_text"))
    blocks = (replace(model, more=()), *model.more)
    for k, block in enumerate(blocks):
        rows = over_texts(rows, rows.columns, "_text", f"_best{k} string, _raw{k} double, _mass{k} double", _scoring(rows, block))
    every = range(len(blocks))
    raw = F.greatest(*[F.col(f"_raw{k}") for k in every])
    # equal scores go to the block with the smaller names
    best = F.coalesce(*[F.when(F.col(f"_raw{k}") == raw, F.col(f"_best{k}")) for k in every])
    above = sum(F.exp(F.col(f"_mass{k}") - raw) for k in every)
    known = F.col("_best0").isNotNull()
    return rows.select(
        *[F.col(f"`{c}`") for c in carried],
        F.coalesce(best, F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(known, F.least(F.lit(1.0), 1 / above)).otherwise(0.0).alias("score"),
    )


def _scoring(frame: DataFrame, block: Model):
    share = frame.sparkSession.sparkContext.broadcast(block)

    def make():
        known = share.value
        return lambda texts: list(block_scores(texts, known))

    return make


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, mod 3, is 1.  A
    document without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score.  Learns from the
    documents not held out; lang, source and id play no part in a prediction.  Repeated
    rows each get their prediction; no rows give no rows."""
    base = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    ).withColumn("held_out", held_out(F.col("doc_id")))
    model = fitted(base.where(~F.col("held_out")), F.xxhash64("doc_id", "text"))
    return with_language(base, ["doc_id", "held_out"], "text", model)

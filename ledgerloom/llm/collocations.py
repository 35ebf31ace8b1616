"""Collocations of two to four words, from counts of the longest windows alone.

Every word of a text opens one window: the word and those that follow it in its piece, four
at most, padded where the piece ends.  These lead columns are counted as they are; a ROLLUP over
them sums ever shorter prefixes, and since every occurrence of a phrase is the prefix of
exactly one window, the sums are the counts of all phrases.

Most windows of a large corpus occur once.  So the pairs of neighbouring words, and then the runs of
three whose pairs are frequent, are first counted by a 64-bit hash.  A window is padded from
the first pair or run on whose hash is rarer than a candidate may be: no phrase that holds it
can be one, and shorter prefixes still count.  The frequent ones reach the tasks as bit
sets of fixed size.  Runs that share a bit or a hash let a window stay longer than it had to
and change no count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import staged

LEAST_COUNT = 30
MOST_WORDS = 4
UNIT = 2_000_000
COVERED = (80, 100)  # a longer phrase with that share of a candidate's count replaces it
TOP = 2000
RUNS = (2, 3)  # lengths of the runs that are counted by their hash
FILTER_BITS = 27  # each bit set of frequent runs has 2 ** FILTER_BITS bits, 16 MB
SLICE_BITS = 20
BLOCK_BYTES = 1_000_000
RUNS_HELD = 2_500_000
ROWS_HELD = 250_000
UNKNOWN = "und"

# Bytes that end a piece, and those between its words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACES = b" \t"
_CLASS = np.array([2 if c in PIECE_ENDS else 1 if c in SPACES else 0 for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

LEADS = [f"w{k}" for k in range(1, MOST_WORDS + 1)]
WINDOWS = pa.schema([("lang", pa.string()), *[(w, pa.string()) for w in LEADS], ("n", pa.int64())])


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The bytes of all texts in blocks of about ``most``, cut where a text or a piece ends, with the
    places in the block where a text begins and the number of the text it opens with."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    start, end = int(offsets[0]), int(offsets[-1])
    while start < end:
        stop = min(end, start + most)
        if stop < end:
            row_end = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            inside = np.flatnonzero(_CLASS[data[max(start, row_end) : stop]] == 2)
            if len(inside):
                stop = max(start, row_end) + int(inside[-1]) + 1
            elif row_end > start:
                stop = row_end
            else:  # a piece longer than a block
                next_row = int(offsets[np.searchsorted(offsets, stop, "left")])
                while stop < next_row and _CLASS[data[stop]] != 2:
                    stop += 1
        first = int(np.searchsorted(offsets, start, "right")) - 1
        begins = offsets[first + 1 : np.searchsorted(offsets, stop, "left")] - start
        yield data[start:stop], begins, first
        start = stop


def words_of(data: np.ndarray, begins: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The lower-cased words of a block in order, the number of the piece of each, and how many
    texts begin in the block up to it."""
    kind = _CLASS[data]
    is_word = kind == 0
    opens, closes = is_word.copy(), is_word.copy()
    opens[1:] &= ~is_word[:-1]
    closes[:-1] &= ~is_word[1:]
    inner = begins[(begins > 0) & (begins < len(data))]
    opens[inner] |= is_word[inner]
    closes[inner - 1] |= is_word[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(begins, starts, "right")
    piece = np.cumsum(kind == 2, dtype=np.int64)[starts] + row
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = _LOWER[data[is_word]]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return words.dictionary_encode(), piece, row


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _hashes(strings: list[str]) -> np.ndarray:
    if not strings:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(strings, object), categorize=False)


def pair_hashes(words: pa.DictionaryArray, piece: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word but the last a hash of its language, itself and the next word, and whether
    both stand in one piece.  ``lang`` is the hash of each word's language."""
    word = _hashes(words.dictionary.to_pylist())[words.indices.to_numpy()]
    return _mixed(_mixed(lang[:-1], word[:-1]), word[1:]), piece[1:] == piece[:-1]


def _blocks_of_words(batch: pa.RecordBatch):
    """Words, pieces and languages of all texts of a batch (lang, text), block by block."""
    langs = batch.column(0).dictionary_encode()
    of_row, hashes = langs.indices.to_numpy(), _hashes(langs.dictionary.to_pylist())
    for data, begins, first in blocks(batch.column(1)):
        words, piece, row = words_of(data, begins)
        if len(words):
            code = of_row[first + row]
            yield words, piece, code, hashes[code], langs.dictionary


def frequent_runs(pair: np.ndarray, together: np.ndarray, sets: Sequence[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the hash of the run that begins there and is one word longer than those of the last
    set, and whether all shorter runs in it are frequent."""
    run, real = pair, together
    for known in sets:
        real = real & _in(known, run, bits)
        run, real = _mixed(run[:-1], run[1:]), real[:-1] & real[1:]
    return run, real


def frequent(texts: DataFrame, sets: Sequence[np.ndarray] = (), least: int = LEAST_COUNT, bits: int = FILTER_BITS) -> np.ndarray:
    """The bit set (2 ** ``bits`` bits as bytes) of the runs that occur ``least`` times, of those whose shorter
    runs are in the given sets; of pairs if there are none."""
    share = texts.sparkSession.sparkContext.broadcast(list(sets))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = share.value
        held: list[np.ndarray] = []
        size = 0

        def counted():
            run, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(n)], ["run", "n"])

        for batch in batches:
            for words, piece, _, lang, _ in _blocks_of_words(batch):
                run, real = frequent_runs(*pair_hashes(words, piece, lang), known, bits)
                held.append(run[real])
                size += len(held[-1])
                if size > RUNS_HELD:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    low = min(SLICE_BITS, bits)
    counts = texts.mapInArrow(count, "run bigint, n bigint").repartition("run").groupBy("run").agg(F.sum("n").alias("n"))
    place = F.shiftrightunsigned("run", 64 - bits)
    kept = counts.where(F.col("n") >= least).select(
        F.shiftright(place, low).cast("int").alias("slice"), place.bitwiseAND(F.lit((1 << low) - 1)).cast("int").alias("bit")
    )

    def set_bits(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            slices, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for number in np.unique(slices).tolist():
                own.setdefault(number, np.zeros(1 << low, bool))[at[slices == number]] = True
        for number, flags in own.items():
            packed = zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], ["slice", "bits"])

    # A slice lies in one partition, so at most 2 ** bits bits reach the driver.
    found = kept.repartition("slice").mapInArrow(set_bits, "slice int, bits binary").collect()
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for number, packed in found:
        part = np.frombuffer(zlib.decompress(packed), np.uint8)
        out[number * len(part) : (number + 1) * len(part)] = part
    return out


def _in(bit_set: np.ndarray, pair: np.ndarray, bits: int) -> np.ndarray:
    place = pair >> np.uint64(64 - bits)
    return (bit_set[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _count_windows(words: pa.DictionaryArray, lang: np.ndarray, goes_on: Sequence[np.ndarray], langs: pa.Array) -> pa.Table:
    """Padded windows of a block; ``goes_on`` says for two words, three and so on whether the window
    of each word is that long."""
    codes = words.indices.to_numpy().astype(np.int32)
    leads = [codes]
    for k, reach in enumerate(goes_on, 1):
        lead = np.full(len(codes), -1, np.int32)
        lead[: len(reach)] = np.where(reach, codes[k : k + len(reach)], -1)
        leads.append(lead)
    table = pa.table({"lang": pa.array(lang), **{name: pa.array(lead) for name, lead in zip(LEADS, leads)}})
    found = table.group_by(["lang", *LEADS], use_threads=False).aggregate([([], "count_all")])
    # the empty string, which no word is, pads
    names = pa.concat_arrays([words.dictionary, pa.array([""], pa.string())])
    spelled = []
    for name in LEADS:
        at = found[name].combine_chunks().to_numpy(zero_copy_only=False)
        spelled.append(names.take(pa.array(np.where(at < 0, len(names) - 1, at))))
    return pa.table([langs.take(found["lang"].combine_chunks()), *spelled, found["count_all"]], schema=WINDOWS)


def windows(texts: DataFrame, sets: Sequence[np.ndarray], bits: int = FILTER_BITS) -> DataFrame:
    """Counts ``n`` of the padded windows (lang, w1 to w4) that each task found."""
    share = texts.sparkSession.sparkContext.broadcast(list(sets))

    def run(batches):
        known = share.value
        held: list[pa.Table] = []
        size = 0

        def merged():
            return pa.concat_tables(held).group_by(["lang", *LEADS], use_threads=False).aggregate([("n", "sum")]).rename_columns(WINDOWS.names)

        for batch in batches:
            for words, piece, code, lang, langs in _blocks_of_words(batch):
                pair, together = pair_hashes(words, piece, lang)
                # each set decides on windows of one word more, and the last on all longer ones
                reach = []
                for k in range(len(known)):
                    hashes, real = frequent_runs(pair, together, known[:k], bits)
                    reach.append(real & _in(known[k], hashes, bits))
                while len(reach) < MOST_WORDS - 1:
                    reach.append(reach[-1][:-1] & reach[-1][1:])
                held.append(_count_windows(words, code, reach, langs))
                size += len(held[-1])
                if size > 2 * ROWS_HELD:
                    held = [merged()]
                    size = len(held[0])
                    if size > ROWS_HELD:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from merged().to_batches()

    return texts.mapInArrow(run, ", ".join(f"{w} string" for w in ("lang", *LEADS)) + ", n bigint")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, bits: int = FILTER_BITS) -> DataFrame:
    """Counts ``f`` of every phrase of up to four words that occurs ``least`` times in a language: lang,
    k (words), phrase, f; and with k 0 the number of all words of the language."""
    texts = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    sets: list[np.ndarray] = []
    for _ in RUNS:
        sets.append(frequent(texts, sets, least, bits))
    found = windows(texts, sets, bits)
    found = found.groupBy("lang", *LEADS).agg(F.sum("n").alias("n"))
    # grouping_id has a bit for every column summed over, the last column's the lowest
    rolled = found.rollup("lang", *LEADS).agg(F.sum("n").alias("f"), F.grouping_id().alias("over"))
    real = F.expr("CASE over " + " ".join(f"WHEN {2 ** (MOST_WORDS - k) - 1} THEN w{k} != ''" for k in range(1, MOST_WORDS + 1)) + " END")
    k = F.lit(MOST_WORDS) - F.bit_count("over")
    # concat_ws passes over the columns that were summed over
    return rolled.where(((F.col("f") >= least) & real) | (F.col("over") == 2**MOST_WORDS - 1)).select(
        "lang", k.cast("int").alias("k"), F.concat_ws(" ", *LEADS).alias("phrase"), "f"
    )


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def mined(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, top: int = TOP, bits: int = FILTER_BITS
) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases of two to four words of one piece that occur ``least`` times (``a``).  A phrase is cut
    where its parts' counts ``l`` and ``r`` give the lowest floor(UNIT * a / (l + r)), the first such
    place on ties.  Those inside a longer phrase that occurs nearly as often go.  The first
    ``top`` by score, count and bytes of the phrase are ranked; ``n`` is the number of all words of the language.

    Null text is empty, null language ``und``.  Repeated rows count as often as they stand there.
    No rows, or texts without words, give no rows.
    """
    counts = staged(phrase_counts(docs, text, lang, least, bits), "phrases")
    candidates = counts.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")
    )
    parts = counts.where("k >= 1")
    heads = parts.select(F.col("lang").alias("h_lang"), F.col("phrase").alias("h_phrase"), F.col("f").alias("l"))
    rests = parts.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_phrase"), F.col("f").alias("r"))
    cuts = cuts.join(heads, (F.col("lang") == F.col("h_lang")) & (F.col("head") == F.col("h_phrase")))
    cuts = cuts.join(rests, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
    cuts = cuts.withColumns({"x": _exact("a") * F.lit(UNIT), "y": _exact("l") + _exact("r")}).withColumn("score", F.expr("x DIV y"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    spans = [(k, first, size) for k in range(3, MOST_WORDS + 1) for size in range(2, k) for first in range(1, k - size + 2)]
    inner = F.array(*[F.when(F.col("k") == k, part(F.lit(first), F.lit(size))) for k, first, size in spans])
    longer = (
        candidates.where("k >= 3")
        .select("lang", "a", F.explode(inner).alias("inside"))
        .where("inside IS NOT NULL")
        .groupBy("lang", "inside")
        .agg(F.max("a").alias("longer"))
        .withColumnRenamed("lang", "i_lang")
    )
    share, whole = COVERED
    covered = _exact("longer") * F.lit(whole) >= _exact("a") * F.lit(share)
    kept = scored.join(longer, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("inside")), "left").where(
        F.col("longer").isNull() | ~covered
    )
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = counts.where("k = 0").select(F.col("lang").alias("n_lang"), F.col("f").alias("n"))
    return ranked.join(sizes, F.col("lang") == F.col("n_lang")).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score"
    )

"""How far the sources of a language differ in their words.

Tasks count terms in columns: texts are lower-cased, split and dictionary-encoded as Arrow arrays and
counted by Arrow's hash grouping, so a task hands on one row per language, source and term.  Spark
merges these rows and keeps the terms that enough documents of a language hold.  The merged
counts are then dealt by term to shards; a shard is a matrix of the language's sources by some of
its terms, and yields the divergence of every two sources over these terms and each
source's most over-used terms.  Shards are summed.

All arithmetic is on whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import CHUNK_CHARS, staged

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SMOOTHING = 2
UNIT = 10**9
THIRDS = 10**3  # UNIT is its third power
CELLS = 400_000  # of a shard's matrix; more where a language has more sources than fit into it squared
ROWS_HELD = 400_000  # partial counts a task holds before it hands them on

# What stands between terms, and the lower-cased letters and others that make them.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_IS_BETWEEN = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def pieces(text: str, most: int = CHUNK_CHARS) -> list[str]:
    """A text cut between terms into pieces of about ``most`` characters."""
    out, start = [], 0
    while len(text) - start > most:
        stop = start + most
        while stop < len(text) and not (text[stop] < "\x80" and ord(text[stop]) in _IS_BETWEEN):
            stop += 1
        out.append(text[start:stop])
        start = stop
    return [*out, text[start:]]


def _term_counts(texts: pa.Array) -> tuple[pa.Table, pa.Array]:
    """(row, code, n) for the terms of each text, and the terms the codes stand for."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    row, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.not_equal(term, "")
    term = term.filter(real).dictionary_encode()
    found = pa.table({"row": row.filter(real), "code": term.indices})
    return found.group_by(["row", "code"]).aggregate([([], "count_all")]).rename_columns(["row", "code", "n"]), term.dictionary


def count_terms(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Counts by language, source and term of some whole documents: occurrences (``n``) and
    documents (``docs``).  A row with the empty term stands for the group itself."""
    sizes = pc.binary_length(text)
    if sizes and pc.max(sizes).as_py() > CHUNK_CHARS:
        cut = [pieces(t) for t in text.to_pylist()]
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        parts = []
        for at, piece in zip(owner, (p for c in cut for p in c)):
            some, terms = _term_counts(pa.array([piece], pa.string()))
            parts.append(pa.table({"row": pa.array(np.full(len(some), at)), "term": terms.take(some["code"].combine_chunks()), "n": some["n"]}))
        whole = pa.concat_tables(parts).group_by(["row", "term"]).aggregate([("n", "sum")])
        terms = whole["term"].combine_chunks().dictionary_encode()
        found, terms = pa.table({"row": whole["row"], "code": terms.indices, "n": whole["n_sum"]}), terms.dictionary
    else:
        found, terms = _term_counts(text)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    row = found["row"].combine_chunks()
    own = pa.table({"lang": langs.indices.take(row), "source": sources.indices.take(row), "code": found["code"], "n": found["n"]})
    sums = own.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    counted = pa.table(
        [
            langs.dictionary.take(sums["lang"].combine_chunks()),
            sources.dictionary.take(sums["source"].combine_chunks()),
            terms.take(sums["code"].combine_chunks()),
            sums["n_sum"],
            sums["count_all"],
        ],
        schema=COUNTS,
    )
    groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([])
    zeros = pa.array(np.zeros(len(groups), np.int64))
    return pa.concat_tables([pa.table([*groups.columns, pa.array([""] * len(groups), pa.string()), zeros, zeros], schema=COUNTS), counted])


def _merged(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns(COUNTS.names)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            stop, chars = start + 1, lengths[start]
            while stop < batch.num_rows and chars + lengths[stop] <= CHUNK_CHARS:
                chars += lengths[stop]
                stop += 1
            piece = batch.slice(start, stop - start)
            held.append(count_terms(*piece.columns))
            size += len(held[-1])
            start = stop
            if size > 2 * ROWS_HELD:
                held = [_merged(held)]
                size = len(held[0])
                if size > ROWS_HELD:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from _merged(held).to_batches()


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def kept_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """Occurrences ``n`` by lang, source and kept term.  ``leads`` is 1 in one row of each kept
    term of a language and else 0; a row with the empty term stands for every group, also
    one without terms."""
    rows = docs.select(_or_empty(lang).alias("lang"), _or_empty(source).alias("source"), _or_empty(text).alias("text"))
    partial = rows.mapInArrow(_count_batches, "lang string, source string, term string, n bigint, docs bigint")
    # One exchange by (lang, term) serves the merging and the document counts.
    merged = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    marked = merged.withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("at", F.row_number().over(of_term.orderBy("source")))
    group = F.col("term") == ""
    leads = F.when(~group & (F.col("at") == 1), 1).otherwise(0).cast("bigint").alias("leads")
    return marked.where(group | (F.col("in_docs") >= least_documents)).select("lang", "source", "term", "n", leads)


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * kept)), in three steps of long
    division, so that no product passes 64 bits below 9 * 10**15 words."""
    over = np.asarray(total, np.int64) + SMOOTHING * kept
    rest = counts + SMOOTHING
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * THIRDS
        digit = rest // over
        out = out * THIRDS + digit
        rest -= digit * over
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shard(counts: pa.Table, totals: pa.Table, top: int) -> pa.Table:
    """The part of all divergences that a shard's terms make up: a row for every two sources
    (the first before the second by bytes) and each source's ``top`` most over-used terms."""
    lang, kept = totals["lang"][0].as_py(), totals["kept"][0].as_py()
    names = totals["source"].to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode("utf-8", "surrogatepass"))
    sources = [names[i] for i in order]
    sums = totals["total"].to_numpy()[order]
    terms = counts["term"].combine_chunks().dictionary_encode() if len(counts) else pa.array([], pa.string()).dictionary_encode()
    words = np.array([t.encode("utf-8", "surrogatepass") for t in terms.dictionary.to_pylist()], object)
    matrix = np.zeros((len(sources), len(words)), np.int64)
    row = pc.index_in(counts["source"].combine_chunks(), pa.array(sources, pa.string())) if len(counts) else pa.array([], pa.int32())
    matrix[row.to_numpy(zero_copy_only=False), terms.indices.to_numpy(zero_copy_only=False)] = counts["n"].to_numpy()
    p = shares(matrix, sums[:, None], kept) if len(words) else matrix
    first, second, value = [], [], []
    for i in range(len(sources) - 1):
        first += [sources[i]] * (len(sources) - 1 - i)
        second += sources[i + 1 :]
        value.append(distances(p[i + 1 :], p[i]).sum(axis=1))
    pairs = pa.table({"source": pa.array(first, pa.string()), "part": pa.array(["pair"] * len(first), pa.string()),
                      "item": pa.array(second, pa.string()), "value": pa.array(np.concatenate(value) if value else [], pa.int64())})
    held_source, held_term, held_value = [], [], []
    if len(words):
        q = shares(matrix.sum(axis=0), sums.sum(), kept)
        for i, name in enumerate(sources):
            more = np.flatnonzero((matrix[i] > 0) & (p[i] > q))
            far = distances(p[i, more], q[more])
            if len(more) > top:  # all that tie with the last place stay
                more, far = (x[far >= np.partition(far, -top)[-top]] for x in (more, far))
            best = sorted(zip((-far).tolist(), words[more]))[:top]
            held_source += [name] * len(best)
            held_term += [w.decode("utf-8", "surrogatepass") for _, w in best]
            held_value += [-v for v, _ in best]
    over = pa.table({"source": pa.array(held_source, pa.string()), "part": pa.array(["term"] * len(held_source), pa.string()),
                     "item": pa.array(held_term, pa.string()), "value": pa.array(held_value, pa.int64())})
    out = pa.concat_tables([pairs, over])
    return out.add_column(0, "lang", pa.array([lang] * len(out), pa.string()))


def audited(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS,
    cells: int = CELLS,
) -> DataFrame:
    """Divergences of the sources of each language: lang, source, part, item, value, rank.

    Part ``pair`` ranks the other sources of the language by their divergence from the source,
    over all kept terms; part ``term`` ranks the ``top`` kept terms that the source uses more than
    its language does.  Ranks go by value, the largest first, then by the item's bytes.

    Null text, lang and source are empty strings.  A group without terms, or a language that
    keeps no term, still has its pairs (with value 0 where nothing is kept); a language with one
    source has none.  Repeated rows are documents of their own.  No rows give no rows.
    """
    counts = staged(kept_counts(docs, text, lang, source, least_documents), "term-counts")
    # As many rows as there are groups; the window meets the sources of one language.
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("leads").alias("leads"))
    of_lang = Window.partitionBy("lang")
    n_sources = F.count("*").over(of_lang)
    # terms of a shard: at least as many as sources, so that the pairs it yields stay fewer than its cells
    shards = F.greatest(F.lit(1), F.ceil(F.col("kept") / F.greatest(cells / n_sources, n_sources))).cast("int")
    totals = totals.withColumn("kept", F.sum("leads").over(of_lang)).withColumn("shards", shards)
    totals = staged(totals.select("lang", "source", "total", "kept", "shards"), "source-totals")
    langs = totals.select(F.col("lang").alias("of_lang"), F.col("shards").alias("of_shards")).distinct()
    dealt = (
        counts.where("term != ''")
        .join(langs, F.col("lang") == F.col("of_lang"))
        .select("lang", F.pmod(F.xxhash64("term"), F.col("of_shards")).cast("int").alias("shard"), "source", "term", "n")
    )
    every = totals.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", "total", "kept")
    found = staged(
        dealt.groupBy("lang", "shard")
        .cogroup(every.groupBy("lang", "shard"))
        .applyInArrow(lambda left, right: _shard(left, right, top), "lang string, source string, part string, item string, value bigint"),
        "shard-divergences",
    )
    halves = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = halves.select(
        "lang",
        F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))),
        "value",
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked_pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best)).select(*columns)
    ranked_terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(*columns)
    return ranked_pairs.unionByName(ranked_terms)

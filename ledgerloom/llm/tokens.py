"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of its documents one after another, in fixed width, and tells where each document
ends.  These ends only grow, so they are Elias-Fano coded: the low bits of each are packed side
by side, the high bits are the gaps of a bit vector with one set bit per document.  The i-th end is
read by selecting the i-th set bit, from a directory of every SELECT_STEP-th, which takes two
to three bits a document beyond the low ones and no table of 64-bit offsets.  The sorted document
ids are coded alike.

Documents are sorted by id across files.  A task writes files under names of its own and reports them
with its rows, so what a lost or repeated task left behind is named by nothing.

Layout of a file, little endian: MAGIC; the header's length (u32); the header as JSON (sizes
and places of all parts); ends; document ids; ids.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import CHUNK_CHARS, shared_folder, staged

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"LLTOKEN1"
SELECT_STEP = 256
IDS_PER_FILE = 32_000_000
IDS_AT_A_TIME = 2_000_000
WORDS_KEPT = 500_000  # spelled words whose ids a worker remembers


# ---------------------------------------------------------------- Elias-Fano


@dataclass(frozen=True)
class Ascending:
    """An Elias-Fano coded list of ``n`` numbers that never fall, each at least 0."""

    n: int
    low_bits: int
    low: np.ndarray  # bytes
    high: np.ndarray  # bytes
    places: np.ndarray  # uint32: place of every SELECT_STEP-th set bit in ``high``

    @staticmethod
    def of(values: np.ndarray) -> Ascending:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return Ascending(0, 0, *(np.zeros(0, t) for t in (np.uint8, np.uint8, np.uint32)))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(int(high[-1]) + 1) // 8), np.uint8)
        np.bitwise_or.at(flags, high >> 3, (1 << (high & 7)).astype(np.uint8))
        return Ascending(n, low_bits, _packed(values, low_bits), flags, high[::SELECT_STEP].astype(np.uint32))

    def select(self, first: int, last: int) -> np.ndarray:
        """The numbers at places ``first`` to ``last`` (exclusive), as uint64."""
        if first >= last:
            return np.zeros(0, np.uint64)
        start = int(self.places[first // SELECT_STEP])
        after = -(-last // SELECT_STEP)
        stop = int(self.places[after]) if after < len(self.places) else len(self.high) * 8
        bits = np.unpackbits(self.high[start >> 3 : -(-(stop + 1) // 8)], bitorder="little")
        bits[: start & 7] = 0
        at = first // SELECT_STEP * SELECT_STEP
        set_bits = np.flatnonzero(bits)[first - at : last - at] + (start & ~7)
        high = (set_bits - np.arange(first, last)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | _unpacked(self.low, self.low_bits, first, last)

    def __getitem__(self, i: int) -> int:
        return int(self.select(i, i + 1)[0])

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.places]


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value side by side, the lowest first."""
    if not width:
        return np.zeros(0, np.uint8)
    held, step = [], 1 << 16  # a multiple of 8 values fills whole bytes
    for at in range(0, len(values), step):
        bits = np.unpackbits(np.ascontiguousarray(values[at : at + step]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        held.append(np.packbits(bits[:, :width].ravel(), bitorder="little"))
    return np.concatenate(held)


def _unpacked(low: np.ndarray, width: int, first: int, last: int) -> np.ndarray:
    if not width:
        return np.zeros(last - first, np.uint64)
    start, stop = first * width, last * width
    bits = np.unpackbits(low[start >> 3 : -(-stop // 8)], bitorder="little")[start & 7 :][: stop - start]
    whole = np.zeros((last - first, 64), np.uint8)
    whole[:, :width] = bits.reshape(-1, width)
    return np.packbits(whole, axis=1, bitorder="little").view(np.uint64).ravel()


# ---------------------------------------------------------------- files


def file_parts(doc_ids: list[int | None], lengths: np.ndarray, width: int) -> bytes:
    """What stands in front of the ids: magic, header and both coded lists.  ``doc_ids`` ascend, null
    ones last."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    # the distance of two 64-bit numbers fits 64 bits without sign
    ids = Ascending.of(known.view(np.uint64) - np.array(least, np.int64).view(np.uint64))
    ends = Ascending.of(np.cumsum(lengths))
    arrays = [*ends.parts(), *ids.parts()]
    header = {
        "documents": len(doc_ids),
        "ids": int(np.sum(lengths)),
        "id_bytes": width,
        "least_doc_id": least,
        "ends": [ends.n, ends.low_bits],
        "doc_ids": [ids.n, ids.low_bits],
        "part_bytes": [a.nbytes for a in arrays],
    }
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *[a.tobytes() for a in arrays]])


class TokenFile:
    """A file of token ids, open for reading through any input with ``read_at(bytes, place)``."""

    def __init__(self, source):
        self.source = source
        start = source.read_at(len(MAGIC) + 4, 0)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        size = int.from_bytes(start[len(MAGIC) :], "little")
        self.header = json.loads(source.read_at(size, len(MAGIC) + 4))
        at = len(MAGIC) + 4 + size
        sizes = self.header["part_bytes"]
        raw = source.read_at(sum(sizes), at)
        cuts = np.cumsum([0, *sizes])
        arrays = [np.frombuffer(raw[a:b], t) for a, b, t in zip(cuts, cuts[1:], (np.uint8, np.uint8, np.uint32) * 2)]
        self.ends = Ascending(*self.header["ends"], *arrays[:3])
        self.known = Ascending(*self.header["doc_ids"], *arrays[3:])
        self.ids_at = at + sum(sizes)
        self.width = self.header["id_bytes"]

    def __len__(self) -> int:
        return self.header["documents"]

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        stop = max(first, min(last, self.known.n))
        least = np.array(self.header["least_doc_id"], np.int64).view(np.uint64)
        return (self.known.select(first, stop) + least).view(np.int64).tolist() + [None] * (last - stop)

    def place(self, doc_id: int) -> int | None:
        """Number of the first document with that id, by binary search."""
        low, high = 0, self.known.n
        while low < high:
            middle = (low + high) // 2
            if self.doc_ids(middle, middle + 1)[0] < doc_id:
                low = middle + 1
            else:
                high = middle
        return low if low < self.known.n and self.doc_ids(low, low + 1)[0] == doc_id else None

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.source.read_at((stop - start) * self.width, self.ids_at + start * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, its end id included."""
        return self.ids(self.ends[i - 1] if i else 0, self.ends[i])

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]]:
        """All documents in runs: their ids, their ends, and the token ids of each."""
        first, before = 0, 0
        while first < len(self):
            last = min(len(self), first + 4096)
            ends = self.ends.select(first, last).astype(np.int64)
            last = first + max(1, int(np.searchsorted(ends, before + IDS_AT_A_TIME, "right")))
            last = min(last, first + len(ends))
            ends = ends[: last - first]
            tokens = self.ids(before, int(ends[-1]))
            yield self.doc_ids(first, last), ends, np.split(tokens, ends[:-1] - before)
            first, before = last, int(ends[-1])


# ---------------------------------------------------------------- encoding


def _loaded(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    return Tokenizer.from_file(path)


# Fixed value: the word pattern whose tokenizers the short way below is made for.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_BELOW = "\u0250"  # Latin letters: single code points, each lower-cased for itself, always in normal form C


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin bytes for
    themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes whole texts.

    A tokenizer that drops white space and splits at it sees no word together with the next, so texts
    are cut at ASCII white space, every different piece is encoded once, and its ids are
    gathered by numpy.  Pieces of plain Latin letters and marks are split into words here, and
    the words go to the tokenizer's model directly.  Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = _loaded(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.specials = [t["content"] for t in settings["added_tokens"]]
        self.drops_space = self._drops_space(settings) and not any(c in s for s in self.specials for c in " \t\n\v\f\r")
        self.words: dict[str, bytes] = {}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.letters = _byte_letters()

    @staticmethod
    def _drops_space(settings: dict) -> bool:
        """Whether it lower-cases, keeps what WORD_PATTERN matches and maps bytes, and does no more."""
        normal, before = settings["normalizer"] or {}, settings["pre_tokenizer"] or {}
        steps = [s["type"] for s in normal.get("normalizers", [])], [s["type"] for s in before.get("pretokenizers", [])]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or settings["post_processor"] is not None:
            return False
        replace, (split, to_bytes) = normal["normalizers"][1], before["pretokenizers"]
        return (
            (replace["pattern"], replace["content"]) == ({"Regex": r"\s+"}, " ")
            and (split["pattern"], split["behavior"], split["invert"]) == ({"Regex": WORD_PATTERN}, "Removed", True)
            and (to_bytes["add_prefix_space"], to_bytes["use_regex"]) == (False, False)
        )

    def _word(self, word: str) -> bytes:
        """Ids of a lower-cased word."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        found = self.words[word] = array(self.code, [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
        return found

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each has."""
        import regex

        pattern, words, word_ids = regex.compile(WORD_PATTERN), self.words, self._word
        if len(words) > WORDS_KEPT:
            words.clear()
        held: list[bytes] = []
        hard = []
        for at, piece in enumerate(pieces):
            found = words.get(piece)
            if found is None:
                low = piece.lower()
                if not (max(piece) < PLAIN_BELOW and piece.isprintable()) or any(s in piece for s in self.specials):
                    hard.append(at)
                elif low.isalpha():
                    found = words.get(low) or word_ids(low)
                elif low[:-1].isalpha():  # a word and a mark or digit
                    found = (words.get(low[:-1]) or word_ids(low[:-1])) + (words.get(low[-1]) or word_ids(low[-1]))
                else:
                    found = b"".join([words.get(w) or word_ids(w) for w in pattern.findall(low)])
            held.append(found)
        if hard:
            for at, got in zip(hard, self.tokenizer.encode_batch_fast([pieces[i] for i in hard], add_special_tokens=False)):
                held[at] = words[pieces[at]] = array(self.code, got.ids).tobytes()
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // self.width
        return np.frombuffer(b"".join(held), f"=u{self.width}"), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        if not self.drops_space:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], f"=u{self.width}"), np.array([len(ids) for ids in found], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        row, pieces = pc.list_parent_indices(lists), pc.list_flatten(lists)
        real = pc.not_equal(pieces, "")
        row, pieces = row.filter(real).to_numpy(), pieces.filter(real).dictionary_encode()
        ids, sizes = self._encode_pieces(pieces.dictionary.to_pylist())
        starts = np.cumsum(sizes) - sizes
        code = pieces.indices.to_numpy()
        own = sizes[code]
        # the n-th id of the output is an id of its piece, so many places on
        shift = np.repeat(starts[code] - (np.cumsum(own) - own), own)
        return ids[shift + np.arange(len(shift))], np.bincount(row, weights=own, minlength=len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, so that tasks share the words it has seen."""
    return Encoder(path)


def tokenizer_path(name: str, folder: str = TOKENIZERS) -> str:
    """Place of a public tokenizer's file, from the module that comes with the files."""
    if folder not in sys.path:
        sys.path.append(folder)
    import public_tokenizers

    return str(public_tokenizers.path(name))


# ---------------------------------------------------------------- Spark


class _Writer:
    """Collects documents into a file of bounded size and writes it when it is full."""

    def __init__(self, folder: str, width: int):
        from pyarrow import fs

        self.system, self.base = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.base, recursive=True)
        self.width, self.held = width, 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lengths.append(lengths)
        self.ids.append(ids.astype(f"<u{self.width}"))
        self.held += len(ids)

    def close(self) -> tuple[str, int, int]:
        name = f"{uuid.uuid4().hex}.ids"
        with self.system.open_output_stream(f"{self.base}/{name}", compression=None) as out:
            out.write(file_parts(self.doc_ids, np.concatenate(self.lengths), self.width))
            for part in self.ids:
                out.write(part.tobytes())
        made = name, len(self.doc_ids), self.held
        self.doc_ids, self.lengths, self.ids, self.held = [], [], [], 0
        return made


def written(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, ids_per_file: int = IDS_PER_FILE
) -> tuple[DataFrame, str]:
    """Encode every document, append ``end_id`` and write the ids in ascending order of document ids
    (null ids last; of equal ids by the text's hash); returns a row per file (``file``, ``documents``,
    ``ids``, and ``start``, the number of ids in the files before it) and the files' folder.

    ``path`` is the tokenizer's file, which executors must be able to open.  Null text is empty.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # A third key deals out rows that are equal in all else; they are the same in any order.
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_spread", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    order = [F.asc_nulls_last("doc_id"), F.asc("_hash"), F.asc("_spread")]
    in_order = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        codec = encoder(path)
        files, first, part = _Writer(folder, codec.width), None, 0
        columns = ["doc_id", "hash", "spread", "part", "file", "documents", "ids"]

        def row():
            values = [*first, part, *files.close()]
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], columns)

        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                stop, chars = start + 1, lengths[start]
                while stop < batch.num_rows and chars + lengths[stop] <= CHUNK_CHARS:
                    chars += lengths[stop]
                    stop += 1
                piece = batch.slice(start, stop - start)
                ids, sizes = codec.encode(piece.column(1))
                whole = np.insert(ids, np.cumsum(sizes), end_id)
                if first is None:
                    first = [piece.column(i)[0].as_py() for i in (0, 2, 3)]
                files.add(piece.column(0).to_pylist(), sizes + 1, whole)
                start = stop
                if files.held >= ids_per_file:
                    yield row()
                    first, part = None, part + 1
        if files.held:
            yield row()

    schema = "doc_id bigint, hash bigint, spread bigint, part bigint, file string, documents bigint, ids bigint"
    made = staged(in_order.mapInArrow(run, schema), "token-files")
    # One row per file, so the driver can number them.
    listed = sorted(made.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["hash"], r["spread"], r["part"]))
    starts = np.cumsum([0, *[r["ids"] for r in listed]])
    named = [(r["file"], r["documents"], r["ids"], int(s)) for r, s in zip(listed, starts)]
    return spark.createDataFrame(named, "file string, documents bigint, ids bigint, start bigint"), folder


def read(files: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{base}/{name}") as source:
                    opened = TokenFile(source)
                    last = 0
                    for doc_ids, ends, tokens in opened.documents():
                        starts = np.r_[last, ends[:-1]]
                        sums = [zlib.crc32(t.astype("<u4").tobytes()) for t in tokens]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, pa.int64()), pa.array(starts + before), pa.array(ends - starts), pa.array(sums, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        last = int(ends[-1])

    listed = files.select("file", "start")
    # as many tasks as files, so that each reads one
    return listed.repartition(max(1, files.count())).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token ids of all documents and read them back: doc_id, start, n_tokens, ids_crc32.

    One row per row of ``docs``, repeated rows and null ids (which come last) included; no rows give
    no rows.  An empty or null text is its end id alone.
    """
    return read(*written(docs, path or tokenizer_path(VOCABULARY), doc_id, text))

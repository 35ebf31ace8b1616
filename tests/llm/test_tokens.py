from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from hypothesis import example, given, settings, strategies as st

from ledgerloom.llm import tokens

PATH = tokens.tokenizer_path(tokens.VOCABULARY)
SCHEMA = "doc_id bigint, text string"


class Memory:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, size, place):
        return self.raw[place : place + size]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def brute(library, rows):
    """Rows in the order of ids, null last; rows of one id in any order."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


TEXTS = ["Hello, World!", "", None, "don't STOP  it's\tfine\n", "Straße ÀÉ日本語 é H̱x", "<|endoftext|> a <|ENDOFTEXT|>", "x" * 300, "a b c", "1234 5.6", "\x00\x1f\x7f"]


def test_round_trip_against_the_library(spark, library):
    rows = [(7 * i - 30, t) for i, t in enumerate(TEXTS * 3)]
    got = tokens.round_trip(spark.createDataFrame(rows, SCHEMA))
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(library, rows)


def test_every_document_of_a_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute(library, [tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, tokens.round_trip(docs).collect())) == want


def test_repeated_rows_null_ids_and_clashing_columns(spark, library, table_of):
    rows = [(5, "a b")] * 40 + [(5, "c")] * 3 + [(None, "z")] * 2 + [(None, None), (2**62, "q"), (-(2**62), "q")]
    got = sorted(map(tuple, tokens.round_trip(table_of(rows, SCHEMA).selectExpr("*", "1 AS _hash", "2 AS _spread", "3 AS start", "4 AS file")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [-(2**62), *[5] * 43, 2**62, None, None, None]
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    strip = lambda rows: sorted((repr(r[0]), *r[2:]) for r in rows)
    assert strip(got) == strip(brute(library, rows))


def test_nothing(spark):
    assert tokens.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_several_files_and_single_documents(spark, library, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 100)
    rows = [(i, f"text number {i} " * (i % 5)) for i in range(200)]
    files, folder = tokens.written(spark.createDataFrame(rows, SCHEMA), PATH, ids_per_file=100)
    listed = sorted(files.collect(), key=lambda r: r["start"])
    assert len(listed) > 8 and sum(r["documents"] for r in listed) == 200
    assert sorted(map(tuple, tokens.read(files, folder).collect())) == brute(library, rows)
    system, base = pa.fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/{listed[3]['file']}") as source:
        opened = tokens.TokenFile(source)
        own = opened.doc_ids(0, len(opened))
        for i, doc_id in enumerate(own):
            assert opened.place(doc_id) == i
            assert opened.document(i).tolist() == [*library.encode(rows[doc_id][1], add_special_tokens=False).ids, 1]
        assert opened.place(own[0] - 1) is None and opened.place(10**9) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=900))
def test_elias_fano_gives_every_number_back(values):
    values = sorted(values)
    coded = tokens.Ascending.of(np.array(values, np.uint64))
    assert coded.select(0, len(values)).tolist() == values
    for i in range(0, len(values), 37):
        assert coded[i] == values[i]
        assert coded.select(i, min(len(values), i + 300)).tolist() == values[i : i + 300]


@pytest.mark.parametrize("step", [1, 1000, 70000])
def test_elias_fano_is_small(step):
    n = 50_000
    ends = np.cumsum(np.random.default_rng(step).integers(1, 2 * step + 1, n))
    coded = tokens.Ascending.of(ends)
    assert coded.select(0, n).tolist() == ends.tolist()
    bits = 8 * sum(a.nbytes for a in coded.parts())
    assert bits <= n * (2.3 + max(0, np.log2(int(ends[-1]) / n)) + 1) < 64 * n


def test_file_of_wide_ids_and_one_of_nothing():
    raw = tokens.file_parts([], np.zeros(0, np.int64), 4)
    assert len(tokens.TokenFile(Memory(raw))) == 0
    ids = np.array([1, 70_000, 2**32 - 1, 1], "<u4")
    opened = tokens.TokenFile(Memory(tokens.file_parts([3, None], np.array([3, 1]), 4) + ids.tobytes()))
    assert opened.document(0).tolist() == ids[:3].tolist() and opened.document(1).tolist() == [1]
    assert opened.doc_ids(0, 2) == [3, None]
    with pytest.raises(ValueError):
        tokens.TokenFile(Memory(b"something else"))


ALPHABET = st.one_of(st.sampled_from("aAzZ'sStT .,!?\t\n09é̱́ßİΣς<|>日  ​"), st.characters(codec="utf-8"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=1, max_size=4))
@example(["H̱ Å", "ΑΣ ΑΣ", "<|startoftext|>x<|endoftext|>"])
def test_pieces_encode_as_whole_texts_do(library, texts):
    ids, sizes = tokens.encoder(PATH).encode(pa.array(texts, pa.string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    codec = tokens.Encoder(path)
    assert not codec.drops_space and codec.width == 2
    texts = ["Hello  world\n\n x", "", "é 日本"]
    ids, sizes = codec.encode(pa.array(texts))
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

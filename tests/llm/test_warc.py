from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
from urllib.parse import quote, unquote

import pytest
from pyarrow import fs

from ledgerloom.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        revisit = data in first and page != first[data]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, url, len(data), digest, "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=repr)


def pages(n, seed=1):
    rng = random.Random(seed)
    rows = [
        (i, f"http://{rng.choice(['a', 'b.a', 'é', 'B.a'])}.com/{rng.randint(0, 9)}", rng.choice(["", "x", "é" * 40, f"<p>{i}</p>"])) for i in range(n)
    ]
    rows += [(n, None, None), (n + 1, "", "a\r\n\r\nb"), (n + 2, "no scheme", "\U0001f600"), (n + 3, "http://a.com/x\ny", "WARC/1.0\r\n\r\n"), (None, "http://a.com/1", "only null"),
             (None, "http://a.com/1", "x"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], "other"), (n + 4, "http://z.org", "long " * 200_000)]
    return rows


@pytest.mark.parametrize("block, part, size", [(300, 500_000, 2**29), (7, 40, 2_000)])
def test_round_trip(table_of, monkeypatch, block, part, size):
    monkeypatch.setattr(warc, "LINES_PER_BLOCK", block)
    monkeypatch.setattr(warc, "CAPTURES_PER_PART", part)
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    rows = pages(250)
    got = warc.archived(table_of(rows, SCHEMA).repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_small_payloads_are_never_revisits(table_of):
    rows = pages(60, 2)
    got = warc.archived(table_of(rows, SCHEMA), least_bytes=10).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 10)


def test_equal_keys_over_many_blocks(table_of, monkeypatch):
    monkeypatch.setattr(warc, "LINES_PER_BLOCK", 3)
    rows = [(5, "http://a.com/", f"t{i}") for i in range(20)] + [(i, "http://a.com/", "u") for i in range(10)]
    got = warc.archived(table_of(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_lookup_of_some_and_of_none(spark, table_of):
    rows = pages(100, 3)
    captures, folder = warc.written(table_of(rows, SCHEMA))
    parts = warc.indexed(captures, folder)
    some = captures.where("page_id IN (4, 50)").select("key", "page_id")
    assert sorted(r["page_id"] for r in warc.looked_up(some, parts, folder).collect()) == [4, 50]
    none = spark.createDataFrame([("", 1), ("com,zzz)/", 1), ("~", 9)], "key string, page_id bigint")
    assert warc.looked_up(none, parts, folder).count() == 0
    system, path = fs.FileSystem.from_uri(folder)
    names = {f.path.rsplit("/", 1)[1].split(".", 1)[1] for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file}
    assert names == {"warc.gz", "idx", "dir"}


def test_damage_is_noticed():
    good = warc.record(1, "http://a.com", b"payload", warc.payload_digest(b"payload"), "response", None)
    assert warc.read_record(good)["payload_bytes"] == 7
    bad = warc.record(1, "http://a.com", b"payload", warc.payload_digest(b"other"), "response", None)
    with pytest.raises(ValueError, match="damaged"):
        warc.read_record(bad)


def test_no_pages(table_of):
    assert warc.archived(table_of([(1, "a", "b")], SCHEMA).limit(0)).count() == 0


URLS = ["http://a.com/x?y=%20z#f", "http://a.com/ü b\r\nX-Injected: 1", "http://日本.jp/", "no scheme", 'quote"s', "tab\there", None, ""]


@pytest.mark.parametrize("url", URLS)
def test_headers_are_those_of_the_format(url):
    """What a reader without private rules sees."""
    payload = b"payload"
    digest = warc.payload_digest(payload)
    first = warc.record(4, url, payload, digest, "response", None)
    again = warc.record(9, url, payload, digest, "revisit", 4)
    for member, kind in ((first, "response"), (again, "revisit")):
        head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
        lines = head.decode("ascii").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        assert lines[0] == "WARC/1.0" and fields["WARC-Type"] == kind and len(fields) == len(lines) - 1
        if url:
            assert fields["WARC-Target-URI"] == quote(url, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
            assert unquote(fields["WARC-Target-URI"]) == unquote(url)
        assert rest[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        assert warc.read_record(member)["url"] == url
    ids = [re.search(rb"WARC-Record-ID: (.*?)\r", gzip.decompress(m)).group(1) for m in (first, again)]
    assert ids[0] != ids[1] and re.search(rb"WARC-Refers-To: (.*?)\r", gzip.decompress(again)).group(1) == ids[0]


def test_files_open_with_their_description_and_read_from_front_to_back(spark, table_of, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3_000)
    monkeypatch.setattr(warc, "PLACES_HELD", 20)
    rows = pages(120, 6)
    captures, folder = warc.written(table_of(rows, SCHEMA))
    parts = warc.indexed(captures, folder)
    assert warc.looked_up(captures, parts, folder).count() >= len({(r[0], r[1]) for r in rows})
    system, path = fs.FileSystem.from_uri(folder)
    archives = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/warc.gz")) if f.is_file]
    records = 0
    for name in archives:
        with system.open_input_stream(name, compression=None) as source:
            raw = gzip.decompress(source.read())
        assert raw.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n") and name.rsplit("/", 1)[1].encode() in raw[:400]
        records += raw.count(b"WARC-Type: response\r\n") + raw.count(b"WARC-Type: revisit\r\n")
    assert len(archives) > 3 and records == len(rows)

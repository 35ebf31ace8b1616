"""WARC archives with a two-level capture index.

Tasks write the records of their rows to archive files, each record a gzip member of its own.
The captures are then sorted by reversed-host URL key; lines of the sorted index go, many at a
time, into compressed blocks, and a sparse directory holds each block's first key and place.
A lookup finds the directory of a key's part, finds the block by binary search, reads that
block alone, and then only the bytes of the record it names.

Files lie in the folder that the cluster shares and are reached through its file system's
URI.  A task writes files under names of its own and reports them with its rows, so what a
lost or repeated task left behind is named by nothing.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import shared_folder, staged
from ledgerloom.llm.urls import host_of

LINES_PER_BLOCK = 300
CAPTURES_PER_PART = 500_000
FILE_BYTES = 512 * 2**20
PLACES_HELD = 100_000  # records a task looks up before it reads them file by file
DATE = "2024-01-01T00:00:00Z"  # of all records: the table has no dates, and reruns agree
LEAST_BYTES = 0
LEVEL = 1


def url_key(url: Column) -> Column:
    """Host parts in reverse, ``)``, then the rest of the URL; the whole URL where there is no
    host, so that all pages of a site stand together and every URL has its own key."""
    reversed_host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    rest = F.regexp_extract(F.substr(url, F.locate("://", url) + 3), r"^[^/?#]*([\s\S]*)$", 1)
    scheme = F.substring_index(url, "://", 1)
    known = F.concat(reversed_host, F.lit(")"), rest, F.lit(" "), scheme)
    return F.coalesce(F.when(F.locate("://", url) > 0, known), F.concat(F.lit(")"), url), F.lit(")"))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_url(url: str) -> str:
    """A URL as it may stand in a header: characters that may not are percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def _packed(head: list[str], block: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, wbits=31)
    return pack.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + pack.flush()


def file_info(name: str) -> bytes:
    """The record that opens an archive file."""
    block = b"software: ledgerloom\r\nformat: WARC File Format 1.0\r\n"
    head = ["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id('file', name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}"]
    return _packed([*head, "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"], block)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member.  A response holds the payload behind HTTP headers; a
    revisit holds the headers only and names the response.

    Headers are those of the format.  Two of our own add what it has no place for: the page's id, and
    a URL that is missing or had to be percent-encoded as it was.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    own = _record_id("response", page_id, digest) if kind == "response" else _record_id("revisit", page_id, digest, url)
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {json.dumps(page_id)}"]
    if url:
        head.append(f"WARC-Target-URI: {header_url(url)}")
    if not url or header_url(url) != url:
        head.append(f"X-Page-Url: {json.dumps(url)}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_record_id('response', refers_to, digest)}")
        head.append(f"X-Refers-To-Page: {json.dumps(refers_to)}")
    return _packed([*head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"], block)


def read_record(member: bytes) -> dict:
    """What a record says; the digest of a response is taken from its payload anew."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != length or payload_digest(payload) != digest:
            raise ValueError(f"record of page {fields['X-Page-Id']} is damaged")
    return {
        "page_id": json.loads(fields["X-Page-Id"]),
        "url": json.loads(fields["X-Page-Url"]) if "X-Page-Url" in fields else fields["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": json.loads(fields.get("X-Refers-To-Page", "null")),
    }


class _Files:
    """Appends byte strings to files of bounded size, each opened by what ``opening`` gives for its
    name; a file appears when it is complete."""

    def __init__(self, folder: str, name: str, opening=lambda name: b""):
        from pyarrow import fs

        self.opening = opening

        self.system, self.base = fs.FileSystem.from_uri(folder)
        self.name, self.open, self.path, self.at = name, None, None, 0
        self.base = f"{self.base}/{name}"
        self.system.create_dir(self.base, recursive=True)

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.open is None or self.at >= FILE_BYTES:
            self.close()
            self.path, self.at = f"{uuid.uuid4().hex}.{self.name}", 0
            self.open = self.system.open_output_stream(f"{self.base}/{self.path}", compression=None)
            first = self.opening(self.path)
            self.open.write(first)
            self.at = len(first)
        start = self.at
        self.open.write(data)
        self.at += len(data)
        return self.path, start, len(data)

    def close(self) -> None:
        if self.open is not None:
            self.open.close()
            self.open = None


class _Reader:
    """Range reads from the files that _Files wrote; keeps few of them open."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.system, base = fs.FileSystem.from_uri(folder)
        self.base, self.files = f"{base}/{name}", {}

    def read(self, path: str, start: int, length: int) -> bytes:
        if path not in self.files:
            if len(self.files) >= 16:
                self.files.pop(next(iter(self.files))).close()
            self.files[path] = self.system.open_input_file(f"{self.base}/{path}")
        return self.files[path].read_at(length, start)


def written(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES):
    """Write a record for every page; returns the index of the captures (``key``, ``page_id``,
    ``file``, ``start``, ``length``) and the folder of the files.

    A null html is an empty payload.  Of records with equal payloads of at least
    ``least_bytes`` bytes the one with the smallest page id is a response and the others
    revisit it; shorter ones are all responses.  Rows that share the smallest id are all
    responses, and so are all rows of a payload that has no other id than null.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    base = pages.select(
        F.col(f"`{page_id}`").cast("bigint").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"),
    ).withColumn("sha", F.sha1("html"))
    repeated = (
        base.where(F.octet_length("html") >= least_bytes)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select(F.col("sha").alias("r_sha"), "first")
    )
    repeated = staged(repeated, "repeated-payloads")
    rows = base.join(repeated, F.col("sha") == F.col("r_sha"), "left").select("page_id", "url", "html", "first", url_key(F.col("url")).alias("key"))

    def write(batches):
        files = _Files(folder, "warc.gz", file_info)
        for batch in batches:
            out = []
            for page, address, text, first, key in zip(*(batch.column(i) for i in range(5))):
                page, payload, first = page.as_py(), text.as_py().encode("utf-8", "surrogatepass"), first.as_py()
                revisit = first is not None and page != first
                place = files.add(
                    record(page, address.as_py(), payload, payload_digest(payload), "revisit" if revisit else "response", first if revisit else None)
                )
                out.append((key.as_py(), page, *place))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["key", "page_id", "file", "start", "length"],
            )
        files.close()

    captures = rows.mapInArrow(write, "key string, page_id bigint, file string, start bigint, length bigint")
    return staged(captures, "captures"), folder


def _order(key: str, page: int | None) -> tuple:
    """Spark's order of (key, page): by bytes, null first."""
    return key.encode("utf-8", "surrogatepass"), page is not None, page or 0


def indexed(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted index in compressed blocks and a directory for each part of it; returns
    one row per part: its first key and page and the place of its directory."""
    n = captures.count()
    parts = n // CAPTURES_PER_PART + 1
    in_order = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")

    def write(batches):
        blocks, lines, directory = _Files(folder, "idx"), [], []

        def flush():
            text = "\n".join(json.dumps(x, ensure_ascii=False) for x in lines)
            place = blocks.add(zlib.compress(text.encode("utf-8", "surrogatepass"), 6))
            directory.append([*lines[0][:2], *place])
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(list(row))
                if len(lines) >= LINES_PER_BLOCK:
                    flush()
        if lines:
            flush()
        blocks.close()
        if directory:
            files = _Files(folder, "dir")
            place = files.add("\n".join(json.dumps(x, ensure_ascii=False) for x in directory).encode("utf-8", "surrogatepass"))
            files.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((*directory[0][:2], *place), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["key", "page_id", "file", "start", "length"],
            )

    schema = "key string, page_id bigint, file string, start bigint, length bigint"
    return staged(in_order.mapInArrow(write, schema), "index-parts")


def looked_up(wanted: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """The records of all captures whose (``key``, ``page_id``) is among the wanted ones, read
    from the archives.  Wanted keys are sorted, so a task reads a block of the index once; the places
    it finds are put in the order of the archives, many at a time, so that a file is opened once for them
    and read from front to back.

    The driver hands the tasks one row per part of the index, one per CAPTURES_PER_PART
    captures: 20,000 rows for ten billion pages.
    """
    spark = parts.sparkSession
    heads = sorted((tuple(r) for r in parts.collect()), key=lambda r: _order(r[0], r[1]))
    share = spark.sparkContext.broadcast(heads)
    tasks = max(1, len(heads), spark.sparkContext.defaultParallelism)
    sorted_keys = wanted.select("key", "page_id").distinct().repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def find(batches):
        known = share.value
        head_keys = [_order(r[0], r[1]) for r in known]
        blocks, directories, archives = _Reader(folder, "idx"), _Reader(folder, "dir"), _Reader(folder, "warc.gz")
        at_part, directory, block_keys, at_block, lines = -1, [], [], None, {}
        places: list[tuple[str, int, int]] = []

        def records():
            places.sort()
            for at in range(0, len(places), 4096):
                found = [read_record(archives.read(*place)) for place in places[at : at + 4096]]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types)], list(names))
            places.clear()

        for batch in batches:
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                asked = _order(key, page)
                part = bisect_right(head_keys, asked) - 1
                if part < 0:
                    continue
                if part != at_part:
                    text = directories.read(*known[part][2:]).decode("utf-8", "surrogatepass")
                    directory = [json.loads(x) for x in text.split("\n")]
                    block_keys = [_order(x[0], x[1]) for x in directory]
                    at_part, at_block = part, None
                # equal keys may begin at the end of the block before
                stop = bisect_right(block_keys, asked)
                start = stop - 1
                while start > 0 and block_keys[start] == asked:
                    start -= 1
                for number in range(max(0, start), stop):
                    if number != at_block:
                        packed = blocks.read(*directory[number][2:])
                        lines = {}
                        for line in zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n"):
                            got = json.loads(line)
                            lines.setdefault((got[0], got[1]), []).append(got[2:])
                        at_block = number
                    places += [tuple(place) for place in lines.get((key, page), ())]
            if len(places) >= PLACES_HELD:
                yield from records()
        yield from records()

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return sorted_keys.mapInArrow(find, schema)


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write all pages, index them, and read every record back through the index: page_id, url,
    payload_bytes, payload_digest, record_type, refers_to.  One row per row of ``pages``,
    repeated rows, null ids and null URLs included; no rows give no rows."""
    captures, folder = written(pages, page_id, url, html, least_bytes)
    parts = indexed(captures, folder)
    wanted = pages.select(url_key(F.col(f"`{url}`")).alias("key"), F.col(f"`{page_id}`").cast("bigint").alias("page_id"))
    return looked_up(wanted, parts, folder)

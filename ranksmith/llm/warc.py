"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offset index.

Crawlers that compress an archive as one gzip stream make it unseekable.  The normaliser inflates such a stream once,
from front to back with a bounded buffer, and rewrites every record as a gzip member of its own; a sidecar index
(``.idx``, tab-separated) names each record's offset and length, so readers fetch a record with one ranged read.

One archive is one task's work: it is written under a name of its own below the shared folder, and only the names in
the table that Spark committed are ever read, so a lost executor or a second attempt leaves at most an unread file.

Payload digests come first, natively; a table of those that several pages share (smallest page_id per digest) decides
which record is the response and which are revisits.  No group of equal pages meets in one task: sums are partial, and
the join is one that adaptive execution can split.

Defined results for odd input
    null or empty html: an empty payload, always a response.  repeated rows with the smallest page_id: each a response.
    null page_id: kept; it is a response only where no equal payload has an id.  null url: no target URI; control
    characters in a url are percent-encoded, ids of any type are kept as percent-encoded text.  Payloads of any length are
    streamed to the archive whole.  Empty table: empty result.  Extra columns play no part.  An archive whose gzip stream
    or last record is cut off: an error.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, stored, stream_arrow

LEAST = 100  # smaller payloads are always responses
MOST_BYTES = 256 << 20  # an archive is closed once it holds this many bytes of records
BLOCK = 1 << 20
_CRLF = b"\r\n"


def _open(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path


def record(kind: str, identity: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{identity}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{k}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + _CRLF + _CRLF


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url)


def page_record(page_id: object, url: str | None, payload: bytes, digest: str, kind: str, refers_to: object) -> bytes:
    """An HTTP response, or the headers alone with a reference for a payload that another record holds."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    headers = {
        "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Page-ID": None if page_id is None else quote(str(page_id)),
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Refers-To-Page-ID": None if refers_to is None else quote(str(refers_to)),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return record(kind, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")), headers, http if kind == "revisit" else http + payload)


class _Inflated(io.RawIOBase):
    """The plain bytes of a gzip file of one or several members, with a bounded buffer.  A file that ends before its last
    member does, checksum and length included, is an error: what was read till then is not the whole."""

    def __init__(self, source):
        self.source, self.z, self.rest, self.out, self.begun = source, zlib.decompressobj(31), b"", b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.out:
            data = self.rest or self.source.read(BLOCK)
            if not data:
                if self.begun and not self.z.eof:
                    raise EOFError("the gzip stream is cut off")
                return 0
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            self.begun = True
            self.out = self.z.decompress(data, BLOCK)
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


def read_head(source: io.BufferedReader) -> tuple[bytes, dict[str, str]] | None:
    """The header lines of the next record as they are, and as a dict with lower-case names; None at the end."""
    first = source.readline()
    while first in (b"\r\n", b"\n"):
        first = source.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    raw, fields = [first], {}
    for line in iter(source.readline, b""):
        raw.append(line)
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return b"".join(raw), fields


def normalise(source, sink, level: int = 6) -> Iterator[tuple[str, str, int, int]]:
    """Inflate the archive once and write each record as a member; yields (record id, type, offset, length) as it goes.

    source: a readable gzip file, of one stream or of several.  sink: a writable file.  A record's block is streamed.
    """
    plain, offset = io.BufferedReader(_Inflated(source), BLOCK), 0
    while (head := read_head(plain)) is not None:
        raw, fields = head
        z, length, left = zlib.compressobj(level, zlib.DEFLATED, 31), 0, int(fields["content-length"])

        def put(piece: bytes) -> int:
            sink.write(piece)
            return len(piece)

        length += put(z.compress(raw))
        while left:
            piece = plain.read(min(left, BLOCK))
            if not piece:
                raise ValueError("the archive ends within a record")
            left -= len(piece)
            length += put(z.compress(piece))
        length += put(z.compress(_CRLF + _CRLF) + z.flush())
        yield fields.get("warc-record-id", ""), fields.get("warc-type", ""), offset, length
        offset += length


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    shared = pages.select("page_id", F.sha2(payload, 256).alias("d"), F.octet_length(payload).alias("n")).where(F.col("n") >= LEAST).groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    joined = rows.join(stored(shared, "shared-payloads"), F.col("payload_digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str, most_bytes: int = MOST_BYTES, level: int = 6) -> DataFrame:
    """One gzip stream per archive, one or more archives per partition; returns (path, records), not yet run.

    pages: the columns of ``typed``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = z = None
        path, records, size = "", 0, 0

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                v = {n: c[i].as_py() for n, c in columns.items()}
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    system, at = _open(path)
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out, z = system.open_output_stream(at, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(z.compress(record("warcinfo", uuid.uuid4().hex, {"Content-Type": "application/warc-fields"}, b"software: ranksmith\r\nformat: WARC File Format 1.1\r\n")))
                data = page_record(v["page_id"], v["url"], v["payload"], v["payload_digest"], v["record_type"], v["refers_to"])
                out.write(z.compress(data))
                records, size = records + 1, size + len(data)
                if size >= most_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return stream_arrow(pages, work, "path string, records long")


def normalise_all(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """(path, index_path, records) of the rewritten archives; archives: column path."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                system, at = _open(source)
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                to_system, to = _open(path)
                to_system.create_dir(to.rsplit("/", 1)[0], recursive=True)
                n = 0
                with system.open_input_stream(at, compression=None) as raw, to_system.open_output_stream(to, compression=None) as sink, to_system.open_output_stream(f"{to}.idx", compression=None) as index:
                    for entry in normalise(raw, sink, level):
                        index.write(("\t".join(map(str, entry)) + "\n").encode())
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f"{path}.idx"]), pa.array([n], pa.int64())], ["path", "index_path", "records"])

    return stream_arrow(archives.select("path"), work, "path string, index_path string, records long")


def read_record(system, path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in a normalised archive: fields and block."""
    with system.open_input_file(path) as f:
        f.seek(offset)
        return _parsed(f.read(length))


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    plain = io.BufferedReader(io.BytesIO(zlib.decompress(member, 31)))
    _, fields = read_head(plain)
    return fields, plain.read(int(fields["content-length"]))


def read_pages(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """The page records of normalised archives, each fetched by its index entry; responses are checked against their digest.

    id_type: the type of the pages' ids, which the archives hold as text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = _open(path)
                rows: list[list] = []
                with system.open_input_stream(_open(index)[1], compression=None) as lines, system.open_input_file(at) as f:
                    for line in io.TextIOWrapper(lines, encoding="utf-8"):
                        _, kind, offset, length = line.rstrip("\n").split("\t")
                        if kind not in ("response", "revisit"):
                            continue
                        f.seek(int(offset))
                        fields, block = _parsed(f.read(int(length)))
                        digest, n = fields["warc-payload-digest"].partition(":")[2], int(fields["warc-payload-length"])
                        if kind == "response":
                            payload = block.split(b"\r\n\r\n", 1)[1]
                            if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: the record at {offset} does not hold its payload")
                        name = lambda k: unquote(fields[k]) if k in fields else None  # noqa: E731, B023
                        rows.append([name("warc-page-id"), n, digest, kind, name("warc-refers-to-page-id")])
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    got = stream_arrow(archives.select("path", "index_path"), work, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return got.select(F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type))


def archive(pages: DataFrame) -> DataFrame:
    """Write pages to monolithic archives, normalise them, and return (path, index_path, records) of the result."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    raw = stored(write_monolithic(typed(pages), f"{folder}/raw"), "warc-raw")
    n = max(1, raw.count())
    return stored(normalise_all(raw.select("path").repartition(n), f"{folder}/records"), "warc-records").repartition(n)


def op10_warc(pages: DataFrame) -> DataFrame:
    return read_pages(archive(pages), pages.schema["page_id"].dataType.simpleString())


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

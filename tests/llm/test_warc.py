import gzip
import hashlib
import io
import zlib

import pyarrow.fs as pafs
import pytest

from ranksmith.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(pages):
    digest = {i: hashlib.sha256((h or "").encode()).hexdigest() for i, (_, _, h) in enumerate(pages)}
    first = {}
    for i, (k, _, _) in enumerate(pages):
        if k is not None:
            first[digest[i]] = min(first.get(digest[i], k), k)
    out = []
    for i, (k, _, h) in enumerate(pages):
        n, f = len((h or "").encode()), first.get(digest[i])
        again = n >= 100 and f is not None and k != f
        out.append((k, n, digest[i], "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_odd_pages(spark):
    big, wide = "<p>é</p>" * 40, "x" * 3_000_000
    pages = [(3, "http://a/", big), (1, "http://b/\r\nX: y", big), (1, None, big), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "u", wide), (8, "u", wide), (9, "u", "WARC/1.1\r\n\r\n" * 20)]
    frame = spark.createDataFrame(pages, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in warc.op10_warc(frame).collect()), key=str)
    assert got == plain(pages)
    assert warc.op10_warc(spark.createDataFrame([], SCHEMA)).count() == 0
    assert warc.op10_warc(frame.selectExpr("*", "1 as d", "2 as n", "'x' as payload", "3 as first")).count() == 11


def test_table_and_files(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    files = warc.archive(pages)
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert sorted((tuple(r) for r in warc.read_pages(files).collect()), key=str) == plain(rows)
    made = files.collect()
    seen = {}
    for f in made:
        system, path = pafs.FileSystem.from_uri(f["path"])
        data = system.open_input_file(path).read()
        entries = [x.split("\t") for x in system.open_input_file(path + ".idx").read().decode().splitlines()]
        assert len(entries) == f["records"] and sum(int(e[3]) for e in entries) == len(data)
        for _, kind, offset, length in entries:  # each record alone is a whole gzip member
            record = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and record.endswith(b"\r\n\r\n")
            if kind == "response":
                fields, block = warc.read_record(system, path, int(offset), int(length))
                seen[int(fields["warc-page-id"])] = block.split(b"\r\n\r\n", 1)[1].decode()
    assert all(seen[k] == (h or "") for k, _, h in rows if k in seen) and len(seen) > 0


def test_normalise_reads_any_gzip_layout():
    records = [warc.record("response", str(i), {"A": "b"}, bytes([i]) * n) for i, n in enumerate((0, 10, 3 << 20, 1))]
    plain_ = b"".join(records)
    one = gzip.compress(plain_)
    odd_cuts = b"".join(gzip.compress(plain_[i : i + 700_001]) for i in range(0, len(plain_), 700_001))
    for source in (one, odd_cuts):
        sink = io.BytesIO()
        entries = list(warc.normalise(io.BytesIO(source), sink))
        data = sink.getvalue()
        assert [zlib.decompress(data[o : o + n], 31) for _, _, o, n in entries] == records
        assert gzip.decompress(data) == plain_


def test_a_cut_off_archive_is_an_error():
    """No checksum, a cut within the data, and a stream cut at a flush point after a whole record."""
    records = [warc.record("response", str(i), {}, bytes([i]) * 500) for i in range(2)]
    whole = gzip.compress(b"".join(records))
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    flushed = z.compress(records[0]) + z.flush(zlib.Z_FULL_FLUSH)
    for cut in (whole[:-8], whole[:-1], whole[: len(whole) // 2], flushed, whole + whole[:-3]):
        with pytest.raises((EOFError, ValueError)):
            list(warc.normalise(io.BytesIO(cut), io.BytesIO()))
    assert len(list(warc.normalise(io.BytesIO(whole + whole), io.BytesIO()))) == 4 and not list(warc.normalise(io.BytesIO(b""), io.BytesIO()))


def test_text_ids(spark):
    big = "<p>same</p>" * 40
    frame = spark.createDataFrame([("b\nc: d", "u", big), ("a é", "u", big), ("z", "u", "short")], "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.op10_warc(frame).collect()}
    assert got == {"a é": ("response", None), "b\nc: d": ("revisit", "a é"), "z": ("response", None)}

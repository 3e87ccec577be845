import gzip
import hashlib
import json
import os
import zlib

import pytest

from reviewloom.llm import warc
from reviewloom.llm.common import new_folder

LONG = "<p>" + "long page " * 30
ROWS = [
    (1, "http://a/", "short"), (2, "http://b/", "short"), (3, None, LONG), (5, "http://c/\r\nX-Evil: 1", LONG), (4, "http://ü/ é", LONG), (6, "", None),
    (None, "http://n/", LONG), (7, "u", "é" * 60 + "\r\n\r\n"), (8, "u", "WARC/1.1\r\n\r\n" * 20), (3, None, LONG), (9, "u", "x" * 99), (10, "u", "x" * 99),
    (11, "u", "y" * 100), (12, "u", "y" * 100), (13, "big", "z" * 700_000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS path", "url AS payload").repartition(2)


def expected(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = min((p for p, _, other in rows if (other or "") == (html or "") and p is not None), default=None)
        revisit = len(body) >= 100 and first is not None and page != first
        out.append((json.dumps(page), len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", json.dumps(first) if revisit else None))
    return sorted(out, key=repr)


def test_records_come_back(spark):
    found = warc.archive_pages(pages(spark), archive_bytes=1500)
    got = [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()]
    assert sorted(got, key=repr) == expected(ROWS)
    for row in found.where("record_type = 'response'").collect():
        assert hashlib.sha256(bytes(row.payload)).hexdigest() == row.payload_digest


def test_files(spark):
    folder = new_folder(spark, "warc-test")
    manifest = warc.write_archives(warc.plan_records(pages(spark), "page_id", "url", "html"), folder, "2020-01-01T00:00:00Z", 1500)
    raw = [row.path for row in manifest.collect()]
    assert len(raw) > 2
    for path in raw:  # one gzip stream from end to end
        stream = zlib.decompressobj(31)
        stream.decompress(open(path, "rb").read())
        assert stream.eof and not stream.unused_data
    index = warc.normalise(manifest, folder).collect()
    for path in {row.path for row in index}:
        lines = [json.loads(line) for line in open(path.replace(".warc.gz", ".index"))]
        assert [line["offset"] for line in lines] == sorted(row.offset for row in index if row.path == path)
        data = open(path, "rb").read()
        assert lines[-1]["offset"] + lines[-1]["length"] == len(data) == os.path.getsize(path)
        whole = gzip.decompress(data)
        assert whole == b"".join(zlib.decompress(data[line["offset"] : line["offset"] + line["length"]], 31) for line in lines)
        assert b"X-Evil" not in whole.replace(b"%0D%0AX-Evil", b"")
    # A normalised archive can be normalised again: members follow each other.
    again = warc.normalise(spark.createDataFrame([(row,) for row in {r.path for r in index}], "path string"), folder)
    assert again.count() == len(index)


def test_cut_off_files_raise():
    whole = gzip.compress(warc.page_record("1", "u", "http://a", b"body", "d", None, "x"))

    class Source:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    assert len(list(warc.read_records_of(warc.inflate(Source(whole), "f"), "f"))) == 1
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_records_of(warc.inflate(Source(whole[:-9]), "f"), "f"))
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.read_records_of(iter([gzip.decompress(whole)[:-6]]), "f"))
    with pytest.raises(ValueError, match="inside a header"):
        list(warc.read_records_of(iter([gzip.decompress(whole)[:30]]), "f"))


def test_no_pages_and_nulls_only(spark):
    assert warc.archive_pages(pages(spark, [])).collect() == []
    rows = [(None, None, LONG), (None, None, LONG)]
    assert [r.record_type for r in warc.archive_pages(pages(spark, rows)).collect()] == ["response", "response"]


def test_large_pages_are_passed_on_in_parts(spark):
    bodies = {i: f"{i % 40} " * 300_000 if i < 50 else "small" for i in range(60)}
    found = warc.archive_pages(pages(spark, [(i, f"http://a/{i}", body) for i, body in bodies.items()]).coalesce(1)).collect()
    assert len(found) == 60
    for row in found:
        page = int(row.page)
        assert (row.record_type, row.refers_to) == (("revisit", str(page - 40)) if 40 <= page < 50 else ("response", None))
        assert row.payload is None or bytes(row.payload) == bodies[page].encode()

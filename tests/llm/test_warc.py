import gzip
import hashlib

import pytest
from pyarrow import fs

from tesserine.llm import common, queries, warc

from ..conftest import SMALL


def resolved(spark, pages):
    headers = warc.write(pages, common.scratch(spark, "test-first"))
    return headers, warc.resolve(headers, common.scratch(spark, "test"))


def want(rows):
    groups = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            groups.setdefault(data, []).append(i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        origin = max(groups.get(data, [i]))
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if origin == i else "revisit", None if origin == i else origin))
    return sorted(out)


def test_query_equals_brute_force(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op2_warc_revisits(spark, SMALL).collect()) == want(rows)


def test_records_of_archives(spark, monkeypatch):
    long, small = "é" * 500, "b" * 999
    rows = [(1, long), (2, long), (9, long), (3, small), (4, small), (5, None), (6, ""), (7, None), (8, "c" * 2_000_000), (10, "\r\n\r\nWARC/1.1\r\n" * 100)]
    pages = spark.createDataFrame([(*r, f"http://h/{r[0]}\r\nX: y" if r[0] % 2 else None, "clash", 5) for r in rows], "page_id long, html string, url string, file string, offset int").repartition(3)
    headers, files = resolved(spark, pages)
    assert sorted(tuple(r) for r in warc.read(spark, files).collect()) == want(rows)
    texts = {}
    for f in files.collect():
        system, path = fs.FileSystem.from_uri(f.file)
        data = system.open_input_file(path).read()
        whole = gzip.decompress(data)
        assert whole.count(b"WARC-Record-ID") == f.n_records
        with common.open_input(f.file) as file:
            for _, _, member in warc.members(file):
                r = warc.parse(member)
                texts[r["page_id"]] = r
    assert all(r["payload"] is None if r["record_type"] == "revisit" else r["payload"] == dict(rows)[i].encode() if dict(rows)[i] else r["payload"] == b"" for i, r in texts.items())
    assert texts[1]["url"] == "http://h/1%0D%0AX: y" and texts[2]["url"] is None
    assert files.agg({"n_records": "sum"}).first()[0] == len(rows) == headers.count()


def test_edge_rows(spark):
    pages = spark.createDataFrame([(None, "u", "x" * 1500), (None, None, "x" * 1500), (3, None, "x" * 1500), (3, None, "x" * 1500), (None, None, None)], "page_id long, url string, html string")
    rows = warc.read(spark, resolved(spark, pages)[1]).collect()
    assert len(rows) == 5 and sorted((r.record_type, r.refers_to) for r in rows if r.payload_bytes) == [("response", None)] + [("revisit", 3)] * 3
    assert warc.read(spark, resolved(spark, pages.limit(0))[1]).count() == 0


def test_record_ids_are_unique_and_payloads_are_checked(spark):
    pages = spark.createDataFrame([(None, "u", "x" * 1500), (None, None, "y"), (3, None, "x" * 1500), (3, None, "x" * 1500)], "page_id long, url string, html string").repartition(2)
    seen, refers = set(), set()
    for f in resolved(spark, pages)[1].collect():
        with common.open_input(f.file) as file:
            for _, _, member in warc.members(file):
                head = dict(x.split(": ", 1) for x in member.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
                assert head["WARC-Record-ID"] not in seen
                seen.add(head["WARC-Record-ID"])
                refers.add(head.get("WARC-Refers-To"))
    assert len(seen) == 4 and len(refers - {None}) == 1 and refers - {None} < seen
    good = warc.record(1, None, b"payload", "response", None, 7, hashlib.sha1(b"payload").hexdigest())
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r", b"pAyload\r"))

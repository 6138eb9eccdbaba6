import base64
import gzip
import hashlib
import io
import json
import random
import zipfile

import pytest

from sievewell.llm import warc_zip as wz

SCHEMA = "page_id long, url string, html string"


def _read(data):
    return lambda at, n: data[at : at + n]


def _brute(rows, least=0):
    same = {}
    for i, (page, url, html) in enumerate(rows):
        payload = (html or "").encode()
        if len(payload) >= least:
            same.setdefault(payload, []).append(((page is not None, page or 0), (url is not None, url or ""), i))
    out = []
    for i, (page, _, html) in enumerate(rows):
        payload = (html or "").encode()
        top = max(same[payload])[-1] if payload in same else i
        kind = "response" if i == top else "revisit"
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, kind, None if i == top else rows[top][0]))
    return sorted(out, key=str)


def _found(df, least=0, **options):
    return sorted((tuple(r)[:5] for r in wz.archived_pages(df, least, **options).collect()), key=str)


CASES = [
    (1, "http://a/", "<p>é€😀</p>"), (2, None, "<p>é€😀</p>"), (2, "http://b c\r\nX: y/ü", "<p>é€😀</p>"), (2, "http://b c\r\nX: y/ü", "<p>é€😀</p>"), (3, "u", None), (4, "u", ""), (None, "u", ""),
    (None, None, "alone\r\n\r\nWARC/1.1\r\n"), (None, None, "alone\r\n\r\nWARC/1.1\r\n"), (5, "u", "x" * 3_000_000), (6, "u", "x" * 3_000_000), (-7, "u", "short"), (-7, "u", "short"), (8, "u", "PK\5\6" * 9),
]


@pytest.mark.parametrize("least", [0, 1, 6])
def test_messy_pages_round_trip(spark, least):
    df = spark.createDataFrame(CASES, SCHEMA).selectExpr("*", "1 AS payload", "'x' AS same", "2 AS top_id", "3 AS path", "4 AS offset").repartition(3)
    assert _found(df, least) == _brute(CASES, least)


def test_no_pages(spark):
    assert _found(spark.createDataFrame([], SCHEMA)) == []


def test_many_copies_and_many_small_packages(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, f"http://h/{i}", "the same page" if i % 3 == 0 else f"page {rnd.random()}" * 20) for i in range(3000)]
    records = wz.page_records(spark.createDataFrame(rows, SCHEMA).repartition(4))
    packages = wz.write_packages(records, f"file://{tmp_path}/warc", package_bytes=40_000)
    assert packages.count() > 8 and packages.agg({"records": "sum"}).first()[0] == 3000
    listed = wz.package_files(spark, f"{tmp_path}/warc")
    found = wz.read_records(listed)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()) == _brute_sorted(rows)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in found.where("record_type = 'response'").collect()}
    assert all(texts[i] == html for i, _, html in rows if i in texts) and len(texts) == 2001
    for r in packages.limit(2).collect():  # another reader finds the same packages sound
        with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
            assert z.testzip() is None and gzip.decompress(z.read(wz.DATA)).count(b"WARC-Type: re") == r["records"]


def _brute_sorted(rows):
    return sorted((p, n, d, k, r) for p, n, d, k, r in _brute(rows))


def test_hot_groups_without_a_small_table(spark, monkeypatch):
    monkeypatch.setattr("sievewell.llm.hot.HOT_ROWS", 50)
    monkeypatch.setattr("sievewell.llm.hot.broadcast_if_small", lambda df, *a: df)
    rows = [(i, "u", "hot" if i % 2 else f"pair {i // 4}") for i in range(400)]
    assert _found(spark.createDataFrame(rows, SCHEMA)) == _brute(rows)


def _zip(entries, prefix=b"", comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, method in entries:
            z.writestr(zipfile.ZipInfo(name), data, method)
        z.comment = comment
    return prefix + out.getvalue()


def test_directory_of_more_entries_than_two_bytes_count():
    data = _zip([(f"archive/{i}", b"", zipfile.ZIP_STORED) for i in range(66_000)], comment=b"PK\5\6 and more")
    found = list(wz.members(_read(data), len(data), block=1000))
    assert len(found) == 66_000 and found[-1].name == "archive/65999" and b"PK\6\7" in data


@pytest.mark.parametrize("prefix", [b"", b"#!/bin/sh\nexit\n"])
def test_zip64_sizes_and_places(monkeypatch, prefix):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)  # values above it go to ZIP64 fields, as those above 4 GB do
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    body = b"x" * 500
    data = _zip([("archive/a.warc", body, zipfile.ZIP_STORED), ("archive/ü.warc", body * 2, zipfile.ZIP_STORED)], prefix)
    a, b = wz.members(_read(data), len(data))
    assert (a.name, b.name, b.size) == ("archive/a.warc", "archive/ü.warc", 1000)
    at = wz.data_start(_read(data), b)
    assert data[at : at + 1000] == body * 2


@pytest.mark.parametrize("name,packed", [("index.cdx", zipfile.ZIP_DEFLATED), ("index.cdxj.gz", zipfile.ZIP_STORED), ("index.cdxj", zipfile.ZIP_STORED)])
def test_packages_of_other_makers(spark, tmp_path, name, packed):
    body = b"".join(one := [b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: 3\r\n\r\nab%d\r\n\r\n" % (i, i) for i in range(5)])
    places = [(sum(map(len, one[:i])), len(one[i])) for i in (4, 1, 2)]  # the index names some records, in its own order
    index = "!meta {}\n".encode()[:0] + "".join(f"k 2020 {json.dumps({'filename': 'd.warc', 'offset': o, 'length': str(n)})}\n" for o, n in places).encode()
    index = gzip.compress(index[:100]) + gzip.compress(index[100:]) if name.endswith(".gz") else index
    (tmp_path / "x.wacz").write_bytes(_zip([("indexes/" + name, index, packed), ("archive/d.warc", body, zipfile.ZIP_STORED), ("pages/pages.jsonl", b"{}", zipfile.ZIP_DEFLATED)]))
    found = wz.read_records(wz.package_files(spark, str(tmp_path))).collect()
    assert sorted((r["record_id"], r["record_type"], bytes(r["payload"]), r["page_id"]) for r in found) == [(f"urn:x:{i}", "resource", b"ab%d" % i, None) for i in (1, 2, 4)]


@pytest.mark.parametrize("damage", [lambda d: d[:-30], lambda d: b"no zip at all", lambda d: d.replace(b"d.warc\", \"offset\": 0", b"d.warc\", \"offset\": 9"), lambda d: d.replace(b"PK\3\4", b"PK\3\5")])
def test_damaged_packages_end_the_job(spark, tmp_path, damage):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    line = f"k 2020 {json.dumps({'filename': 'd.warc', 'offset': 0, 'length': len(record) - 9})}\n".encode()
    (tmp_path / "x.wacz").write_bytes(damage(_zip([("indexes/index.cdxj", line, zipfile.ZIP_STORED), ("archive/d.warc", record, zipfile.ZIP_STORED)])))
    with pytest.raises(Exception, match=r"x\.wacz"):
        wz.read_records(wz.package_files(spark, str(tmp_path))).collect()


def test_packed_archives_cannot_be_read_by_ranges(spark, tmp_path):
    line = json.dumps({"filename": "d.warc", "offset": 0, "length": 5}).encode()
    (tmp_path / "x.wacz").write_bytes(_zip([("indexes/index.cdxj", b"k 1 " + line, zipfile.ZIP_STORED), ("archive/d.warc", b"x" * 100, zipfile.ZIP_DEFLATED)]))
    with pytest.raises(Exception, match="not stored"):
        wz.read_records(wz.package_files(spark, str(tmp_path))).collect()


def test_a_payload_that_is_not_the_stated_one_ends_the_job():
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:{wz.base32_sha1(b'x')}\r\nContent-Length: 1\r\n\r\n"
    assert wz.parsed_record(head.encode() + b"x\r\n\r\n")["payload_bytes"] == 1
    with pytest.raises(ValueError, match="stated digest"):
        wz.parsed_record(head.encode() + b"y\r\n\r\n")

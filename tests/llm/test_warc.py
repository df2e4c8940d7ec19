import gzip
import hashlib
import os
import random

import pytest
from loam.llm import warc
from loam.llm.common import new_path
from loam.sources.address import filesystem
from pyspark.sql import functions as F


def archive(n=20, compress=True):
    parts = [warc.record_bytes(i, f"http://x/{i}", f"page {i} ".encode() * (10 + i), compress=compress) for i in range(n)]
    starts = [sum(map(len, parts[:i])) for i in range(n + 1)]
    return b"".join(parts), starts


def split(data):
    out = list(warc.salvage(data))
    return [x.page_id for x in out if isinstance(x, warc.Record)], [x for x in out if not isinstance(x, warc.Record)]


def test_whole_archives():
    for compress in (True, False):
        data, _ = archive(compress=compress)
        assert split(data) == (list(range(20)), [])
    assert gzip.decompress(archive()[0]).startswith(b"WARC/1.1\r\n")
    assert split(b"") == ([], [])


def test_damage_loses_only_what_it_hits():
    for compress in (True, False):
        data, at = archive(compress=compress)
        hurt = bytearray(data)
        hurt[at[5] + 40] ^= 0xFF
        got, gaps = split(bytes(hurt))
        assert got == [i for i in range(20) if i != 5] and [g[:2] for g in gaps] == [(at[5], at[6])]
        got, gaps = split(data[: at[3]] + b"rubbish \x1f\x8b\x08 WARC/1.1\r\n" + data[at[3] :])
        assert got == list(range(20)) and len(gaps) == 1 and gaps[0][0] == at[3]
        got, gaps = split(data[: at[7] + 30] + data[at[9] :])
        assert got == [i for i in range(20) if i not in (7, 8)] and len(gaps) == 1
        got, gaps = split(data[:-10])
        assert got == list(range(19)) and gaps[0][:2] == (at[19], len(data) - 10)
    assert split(b"nothing here") == ([], [(0, 12, "no version line")])


def test_a_version_line_within_a_payload_is_no_record():
    inner = warc.record_bytes(99, "u", b"inner", compress=False)
    data = warc.record_bytes(1, "u", b"x" + inner, compress=False) + warc.record_bytes(2, "u", b"y", compress=False)
    assert split(data) == ([1, 2], [])


def test_round_trip(spark):
    long, short = "é" * 600, "short"
    rows = [(1, "u", long), (2, "u\r\nx", long), (7, None, long), (7, None, long), (3, "u", short), (4, "u", short), (5, "u", None), (6, "u", ""), (None, "u", long), (8, "u", "z" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "target": F.lit(2), "body": F.lit("b")})
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len((h or "").encode()), sha(h)) for i, _, h in rows)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "revisit", 7), ("2", "revisit", 7), ("7", "response", None), ("7", "revisit", 7), ("None", "revisit", 7)] + [(str(i), "response", None) for i in (3, 4, 5, 6, 8)])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_archives_and_payloads(spark):
    rows = [(i, f"http://h/{i}", f"text {i} " * 300) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_path(spark, "warc-test")
    index = warc.write(pages, folder, archive_bytes=2000)
    assert index.count() == 50 and index.select("archive").distinct().count() > 5
    got = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert {i: bytes(r.payload).decode() for i, r in got.items()} == {i: h for i, _, h in rows} and got[3].url == "http://h/3"


def foreign(kind, block, *extra, name="1"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Length: {len(block)}", *extra]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_undamaged_records_from_elsewhere_are_returned():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    chunked = http[:-2] + b"Transfer-Encoding: chunked\r\n\r\n" + b"3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"
    parts = [
        foreign("warcinfo", b"software: x\r\n"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To: <urn:b>"),
        foreign("response", http + b"no length, no digest"),
        foreign("response", chunked, f"WARC-Payload-Digest: {warc._sha1(b'abcde')}"),
        foreign("response", http + b"hex", f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'hex').hexdigest()}", f"WARC-Block-Digest: md5:{hashlib.md5(http + b'hex').hexdigest()}"),
        foreign("response", http[:-2] + b"Content-Length: 99\r\n\r\ncut", "WARC-Truncated: length"),
        foreign("resource", b"a file", "WARC-Target-URI: file:///a", f"WARC-Block-Digest: {warc._sha1(b'a file')}"),
        foreign("revisit", http),
        foreign("metadata", b""),
    ]
    for data in (b"".join(parts), b"".join(map(gzip.compress, parts))):
        got = list(warc.salvage(data))
        assert [x.kind for x in got] == ["warcinfo", "request", "response", "response", "response", "response", "resource", "revisit", "metadata"]
        assert got[2].payload == b"no length, no digest" and got[2].digest == hashlib.sha1(got[2].payload).hexdigest()
        assert got[6].payload == b"a file" and got[7].payload_bytes is got[7].digest is None
    for bad in (
        foreign("response", http + b"x", f"WARC-Payload-Digest: {warc._sha1(b'y')}"),
        foreign("response", http[:-2] + b"Content-Length: 99\r\n\r\ncut"),
        foreign("resource", b"x", f"WARC-Block-Digest: {warc._sha1(b'y')}"),
        foreign("resource", b"x", "WARC-Date: 2020-01-01T00:00:00Z"),
        foreign("revisit", http, "WARC-Payload-Digest: sha1:??"),
    ):
        got = list(warc.salvage(bad + parts[0]))
        assert [isinstance(x, warc.Record) for x in got] == [False, True]


def test_damaged_archives_give_all_other_records_and_the_gaps(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, f"http://h/{i}", f"text {i} " * rng.randrange(1, 600)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_path(spark, "warc-damaged")
    index = {r.page_id: (r.archive, r.at, r.length) for r in warc.write(pages, folder, archive_bytes=4000).collect()}
    path = filesystem(folder)[1]
    hit = set(rng.sample(sorted(index), 15))
    for i in hit:
        archive, at, length = index[i]
        with open(f"{path}/{archive}", "r+b") as f:
            f.seek(at + rng.randrange(12, length - 9))  # behind the member's head and before its checksum
            f.write(b"\x00\xff\x00\xff")
    for crc in os.listdir(path):
        if crc.startswith(".") and crc.endswith(".crc"):
            os.remove(f"{path}/{crc}")
    got = warc.read(spark, folder).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type != "gap"} == {i: h for i, _, h in rows if i not in hit}
    gaps = [(r.archive.rsplit("/", 1)[1], r.start, r.end) for r in got if r.record_type == "gap"]
    assert all(any(a == index[i][0] and s <= index[i][1] and index[i][1] + index[i][2] <= e for a, s, e in gaps) for i in hit)
    assert sum(e - s for _, s, e in gaps) == sum(index[i][2] for i in hit) and all(r.reason for r in got if r.record_type == "gap")
    monkeypatch.setattr(warc, "read", lambda *_, **__: spark.createDataFrame([r for r in got], warc.RECORDS))
    with pytest.raises(Exception, match="damaged archive"):
        warc.round_trip(pages.limit(2)).collect()


def test_records_larger_than_an_archive(spark):
    rng = random.Random(12)
    big = "".join(rng.choices("abcdefghijklmnop", k=1 << 20)) * 18
    rows = [(1, "u", big), (2, "u", big), (3, "u", "é" + big), (4, "u", "small")]
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, len(big), "revisit", 2), (2, len(big), "response", None), (3, len(big) + 2, "response", None), (4, 5, "response", None)]


def test_hot_payloads_are_planned_without_dealing(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "x" * 1200 if i % 2 else f"{i}" * 700) for i in range(40)] + [(3, "u", "x" * 1200), (2, "u", "y")], "page_id long, url string, html string")
    want = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    monkeypatch.setattr(warc, "HOT_PAGES", 5)
    monkeypatch.setattr(warc, "HOT_SHARE", 10)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == want

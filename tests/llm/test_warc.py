import gzip
import io

import pytest

from inkwell.llm.common import scratch_path
from inkwell.llm.registry import ORACLE_SQL, QUERIES
from inkwell.llm.warc import WarcError, read_archives, read_records, record, with_revisits, write_archives

from ..oracle import compare, connect


def test_pages_match_sql(spark, mid):
    compare(connect(mid), QUERIES["op6_warc"](spark, mid), ORACLE_SQL["op6_warc"])


def test_round_trip_with_odd_rows(spark):
    big = "é" * 700
    rows = [(1, "u", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", big), (7, "u", big), (8, "u", "y" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int").repartition(3)
    folder = scratch_path(spark, "test-warc")
    out = read_archives(write_archives(with_revisits(df), folder), folder).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out) == [
        (1, 1400, "revisit", 7), (2, 1400, "revisit", 7), (3, 0, "response", None), (4, 0, "response", None), (5, 999, "response", None),
        (6, 999, "response", None), (7, 1400, "response", None), (7, 1400, "response", None), (8, 3_000_000, "response", None)]
    assert {r.page_id: r.payload for r in out}[7].decode() == big


def test_a_record_is_a_gzip_member_and_damage_is_seen():
    import hashlib

    good = record("response", "u", "<urn:page:1>", b"hello", hashlib.sha1(b"hello").digest(), None)
    assert gzip.decompress(good + good).count(b"WARC/1.1") == 2
    assert len(list(read_records(io.BytesIO(good + good)))) == 2
    bad = record("response", "u", "<urn:page:1>", b"hello", hashlib.sha1(b"other").digest(), None)
    for data in (bad, good[:-9], gzip.compress(gzip.decompress(good)[:-2]), gzip.compress(gzip.decompress(good).replace(b"hello", b"hellO"))):
        with pytest.raises(WarcError):
            list(read_records(io.BytesIO(data)))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = scratch_path(spark, "test-warc")
    assert read_archives(write_archives(with_revisits(df), folder), folder).collect() == []


def test_records_of_other_writers():
    import base64
    import hashlib

    sha = hashlib.sha1(b"body").hexdigest()
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/warc-fields\r\nCONTENT-LENGTH: 9\r\n\r\nsoftware:\r\n\r\n"
    plain = b"WARC/1.1\r\nWARC-Type:resource\r\nWARC-Target-URI: a\r\n b\r\nWARC-Payload-Digest: SHA1:" + sha.upper().encode() + b"\r\nContent-Length:4\r\n\r\nbody\r\n\r\n"
    other = plain.replace(b"SHA1:" + sha.upper().encode(), b"sha-256:" + base64.b32encode(hashlib.sha256(b"body").digest()))
    odd = plain.replace(b"SHA1:", b"crc99:")
    got = list(read_records(io.BytesIO(b"".join(map(gzip.compress, (info, plain, other, odd))))))
    assert [(f["WARC-Type"], b) for f, b, _ in got] == [("warcinfo", b"software:"), *[("resource", b"body")] * 3]
    assert [d for *_, d in got[1:]] == [sha] * 3 and got[1][0]["WARC-Target-URI"] == "a b"
    for bad in (plain.replace(b"Content-Length:4\r\n", b""), plain.replace(b"WARC-Type:resource\r\n", b""), plain.replace(sha.upper().encode(), b"0" * 40), b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(WarcError):
            list(read_records(io.BytesIO(gzip.compress(bad))))


def test_odd_urls_and_ids(spark):
    urls = ["http://a/\r\nWARC-Type: evil\r\n\r\nx", "http://a/ b\tc", "http://ä/é", ""]
    df = spark.createDataFrame([(None, u, "z" * 2000) for u in urls] + [(i, u, "z" * 2000) for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = scratch_path(spark, "test-warc")
    out = read_archives(write_archives(with_revisits(df), folder), folder).collect()
    assert sorted((r.page_id is None, r.page_id, r.record_type, r.refers_to) for r in out if r.page_id is not None) == [(False, i, "revisit", 3) for i in range(3)] + [(False, 3, "response", None)]
    assert sum(r.page_id is None and r.record_type == "response" for r in out) == 4
    assert {r.url for r in out} == {"http://a/%0D%0AWARC-Type:%20evil%0D%0A%0D%0Ax", "http://a/%20b%09c", "http://ä/é", ""}

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from flowlab.llm import warc as q
from flowlab.session import fresh_path
from flowlab.sources.tables import table


def expected(rows):
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        smallest = first.get(html or "")
        response = page == smallest
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "response" if response else "revisit", None if response else smallest))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_all_pages(spark, data):
    pages = table(spark, data, "pages")
    result = q.round_trip(pages)
    assert got(result) == expected([(r.page_id, r.html) for r in pages.collect()])
    assert result.where("status <> 'ok'").count() == 0


def test_odd_pages(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nü"
    rows = [(1, None), (2, ""), (3, tricky), (4, tricky), (None, tricky), (5, "z" * 100_000), (6, "z" * 100_000), (3, tricky), (None, None), (7, "é" * 40_000)]
    df = spark.createDataFrame([(p, None if p == 1 else "http://x/ü \r\n", h, "x") for p, h in rows], "page_id long, url string, html string, digest string")
    assert got(q.round_trip(df.repartition(4))) == expected(rows)


def test_no_pages(spark):
    assert q.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chunked_framing():
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        payload = bytes(i % 251 for i in range(n))
        assert q.unchunked(q.chunked(payload)) == payload
    assert q.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc"):
        with pytest.raises(ValueError):
            q.unchunked(bad)


@pytest.fixture()
def segments(spark):
    path = fresh_path(spark, "warc-test")
    pages = spark.createDataFrame([(i, None, f"{i}" * 50_000) for i in range(1, 5)], "page_id long, url string, html string")
    q.write_archives(pages, path, segment=1000)
    return q.parsed(spark, path, segmented=True).repartition(7).cache()


def test_segments_in_any_order_and_twice(segments):
    whole = q.decoded(q.reassembled(segments.union(segments))).collect()
    assert {r.page_id: bytes(r.payload) for r in whole} == {i: (f"{i}" * 50_000).encode() for i in range(1, 5)}


def test_broken_segments(segments):
    page = F.col("origin") == segments.where("page_id = 2").first().origin
    cut = segments.where(~(page & (F.col("number") == 3)))
    other = segments.where("page_id = 3").first().origin
    differs = segments.where((F.col("origin") == other) & (F.col("number") == 2)).withColumn("block", F.lit("x").cast("binary"))
    no_total = segments.where("page_id = 4").first().origin
    cut = cut.withColumn("total", F.when(F.col("origin") != no_total, F.col("total")))
    status = {r.page_id: (r.status, r.payload is None) for r in q.decoded(q.reassembled(cut.union(differs))).collect()}
    assert status == {1: ("ok", False), 2: ("incomplete", True), 3: ("incomplete", True), 4: ("incomplete", True)}

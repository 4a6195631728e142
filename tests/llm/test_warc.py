import base64
import hashlib

import pyarrow.parquet as pq
import pytest

from tracewright.llm import warc as w


def brute(rows, least=0):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    for page, _, html in order:
        b = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(b).digest()).decode()
        if len(b) < least or b not in first:
            first.setdefault(b, page)
            out.append((page, len(b), sha, "response", None))
        else:
            out.append((page, len(b), sha, "revisit", first[b]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_archive(spark, least):
    rows = [(5, "http://a/é", "<p>x</p>"), (3, "u\r\nInjected: 1", "<p>x</p>"), (9, None, "<p>x</p>"), (1, "u", None), (2, "u", ""), (2, "u", ""), (7, "u", "\r\n\r\n\r\n"), (8, "u", "é" * 100_000), (8, "v", "é" * 100_000), (None, "u", "only null"), (None, None, "<p>x</p>"), (10, "u", "ab"), (11, "u", "ab")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    path = w.write_archive(pages, least_bytes=least)
    assert sorted(map(tuple, w.summarize(spark, path).collect()), key=str) == brute(rows, least)
    payloads = [r["payload"] for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert sorted(map(bytes, payloads)) == sorted({(r[2] or "").encode() for r in rows})
    record = next(bytes(r["record"]) for r in w.read_records(spark, path).collect() if b"X-Page-ID: 5\r" in bytes(r["record"]))
    assert (b"WARC-Type: revisit" in record) == (least <= 8) and w.parse_record(record)[0]["warc-target-uri"] == "http://a/é"


def test_given_pages_and_none(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, w.summarize(spark, w.write_archive(pages)).collect()), key=str) == brute(rows)
    assert w.summarize(spark, w.write_archive(pages.where("false"))).count() == 0


def test_a_changed_payload_is_found(spark):
    path = w.write_archive(spark.createDataFrame([(1, "u", "good")], "page_id long, url string, html string"))
    row = spark.read.parquet(f"{path}/payloads").first()
    spark.createDataFrame([(row["digest"], bytearray(b"evil"))], "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        w.summarize(spark, path).collect()

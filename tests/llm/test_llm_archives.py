"""Archives: round trips, revisits against brute force, and the header lines of both ARC versions."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from switchyard.llm import archives as ar

PAGES = "page_id long, url string, html string, type string, n long"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for page, html in rows:
        if len((html or "").encode()) >= least:
            first.setdefault(html or "", []).append((page is None, page or 0, page))
    out, used = [], set()
    for page, html in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        body, kept = html or "", min(first.get(html or "", [(False, 0, page)]))[2]
        again = len(body.encode()) >= least and (page != kept or body in used)
        used |= {body} if page == kept else set()
        out.append((page, len(body.encode()), sha(html), "revisit" if again else "response", kept if again else None, True))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://a.example/{k}", f"<p>page {k % 40}</p>\r\n\r\nWARC/1.1\r\nfiledesc://x 1 2 3\n") for k in range(120)]
    rows += [(k, "http://hot.example/", "hot " * 50) for k in range(1000, 1060)]
    rows += [(200, None, None), (201, "a b\tc", ""), (202, "é", "ü" * 100_000), (203, "x", "\n"), (203, "x", "\n"), (None, "y", "no id"), (None, "y", "hot " * 50), (204, "x", "HTTP/1.1 200 OK\r\n\r\n")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)


@pytest.mark.parametrize("least", [0, 5, 500])
def test_pages_come_back_and_copies_are_revisits(spark, pages, least):
    got = sorted((tuple(r) for r in ar.archived(pages.repartition(5), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=str)
    assert got == brute([(r.page_id, r.html) for r in pages.collect()], least)


def test_no_pages(spark, pages):
    assert ar.archived(pages.where("false")).count() == 0


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    table = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    got = ar.looked_up(rows, table, ["k"], hot=10)
    assert got.count() == 1000 and got.where("v <> 2 * k").count() == 0
    assert ar.looked_up(rows.where("false"), table, ["k"]).count() == 0


def test_header_lines_are_read_by_their_version():
    head = b"HTTP/1.0 200 OK\nX-Page-Id: 7\n\n"
    one = b"filedesc://f 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\n" + ar.ARC_FIELDS[1].encode() + b"\n\n"
    one = one.replace(b" 76\n", f" {len(one.split(bytes([10]), 1)[1])}\n".encode())
    one += b"\nhttp://a b/ 1.2.3.4 19961104142103 text/html 33\n" + head + b"abc"
    two = b"filedesc://f 0.0.0.0 20000101 text/plain 200 - - 0 f 140\n2 0 x\n" + ar.ARC_FIELDS[2].encode() + b"\n\n"
    two = two.replace(b" f 140\n", f" f {len(two.split(bytes([10]), 1)[1])}\n".encode())
    two += b"\ndns:a 1.2.3.4 199611 text/dns 200 - - 12 f 5\nab\ncd"
    (first,), (second,) = (list(ar.arc_records(io.BytesIO(x))) for x in (one, two))
    assert first[1:3] == (1, {"url": b"http://a b/", "ip-address": b"1.2.3.4", "archive-date": b"19961104142103", "content-type": b"text/html", "archive-length": b"33"}) and first[3] == head + b"abc"
    assert ar.http_parts(first[3]) == (head, b"abc") and ar.http_field(head, b"x-page-id") == b"7"
    assert second[1] == 2 and second[2]["result-code"] == b"200" and second[2]["filename"] == b"f" and second[3] == b"ab\ncd"
    assert list(ar.arc_records(io.BytesIO(b"http://x/ 1.1.1.1 2000 text/html 2\nhi\n")))[0][1] == 1
    assert ar.timestamp("19961104142103") == "1996-11-04T14:21:03Z" and ar.timestamp("199611") == "1996-11-01T00:00:00Z"
    with pytest.raises(ValueError, match="ends within"):
        list(ar.arc_records(io.BytesIO(two[:-1])))


def test_other_records_are_resources(spark, tmp_path):
    line = b"dns:a.example 1.2.3.4 20010203040506 text/dns 4\nabcd\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0").write_bytes(gzip.compress(line) + gzip.compress(line))  # two members, no version block
    ar.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    rows = ar.read_warc(spark, f"file://{tmp_path}/warc").collect()
    assert [(r.type, r.date, r.payload_bytes, r.payload_digest, r.page_id, r.intact) for r in rows] == [("resource", "2001-02-03T04:05:06Z", 4, sha("abcd"), None, True)] * 2
    assert len({r.record_id for r in rows}) == 2

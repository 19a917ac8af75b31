"""Round trips of WARC archives, and archives that are damaged."""

import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from usagelens.llm import warc
from usagelens.sources.workspace import fresh_path

TRICKY = "head\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n0\r\n\r\n" + "é日" * 3000
ROWS = [
    (1, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (3, "http://a/3", "x" * 99), (4, "http://a/4", "x" * 99),
    (5, None, None), (6, "http://a/6\r\nX-Injected: y", ""), (7, "http://a/7", TRICKY), (8, "http://a/8", TRICKY),
    (9, "http://a/9", "long " * 60_000), (0, "http://a/0", "x" * 100), (None, "http://a/n", "y" * 300), (10, "http://a/10", "y" * 300),
    (11, "http://a/11", "twice " * 40), (11, "http://a/11", "twice " * 40),
]


@pytest.fixture
def pages(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        return df.withColumns({c: F.lit("clash") for c in ("payload", "digest", "bytes", "record_id", "first", "record", "value")})

    return make


def expected(rows):
    out = set()
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        revisit = len(body) >= 100 and same and min(same) != page
        out.add((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    return out


@pytest.mark.parametrize("segment_bytes, chunk_bytes", [(16_384, 4_096), (300, 7)])
def test_round_trip(spark, pages, segment_bytes, chunk_bytes):
    path = fresh_path(spark, "warc")
    warc.write_archives(pages(ROWS).repartition(3), path, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes, records_per_file=20)
    got = warc.read_pages(spark, path).collect()
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == expected(ROWS)
    assert len(got) == len(ROWS) and all(r["intact"] for r in got)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_payloads(spark, path).where("record_type = 'response'").collect()}
    assert texts[7] == TRICKY and texts[9] == "long " * 60_000 and texts[5] == ""


def test_empty_table(spark, pages):
    path = fresh_path(spark, "warc")
    warc.write_archives(pages(ROWS).limit(0), path)
    assert warc.read_pages(spark, path).count() == 0


def test_missing_segment_and_cut_off_archive_are_told(spark, tmp_path):
    def record(kind, name, block, **fields):
        lines = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Page-ID": "1", **{k.replace("_", "-"): v for k, v in fields.items()}, "Content-Length": len(block)}
        return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + block + b"\r\n\r\n"

    first = record("response", "<a>", b"HTTP/1.1 200 OK\r\n\r\nab", WARC_Segment_Number=1)
    last = record("continuation", "<c>", b"ef", WARC_Segment_Number=3, WARC_Segment_Origin_ID="<a>", WARC_Segment_Total_Length=25)
    (tmp_path / "one.gz").write_bytes(gzip.compress(first) + gzip.compress(last))
    (tmp_path / "two.gz").write_bytes(gzip.compress(record("response", "<b>", b"HTTP/1.1 200 OK\r\n\r\nwhole") + first[:-9]))
    got = {r["record_id"]: (r["intact"], r["payload"]) for r in warc.read_payloads(spark, str(tmp_path)).collect()}
    assert got["<a>"] == (False, None) and bytes(got["<b>"][1]) == b"whole" and got[None][0] is False


def test_equal_rows_are_a_record_each(spark, pages):
    """Repeated rows, whole, segmented and revisits, come back as often as they are in the table."""
    rows = [(3, "u", "short")] * 3 + [(4, "u", "long " * 9_000)] * 2 + [(9, "v", "long " * 9_000)] * 4 + [(None, None, None)] * 2
    path = fresh_path(spark, "warc")
    warc.write_archives(pages(rows), path, segment_bytes=5_000)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["intact"]) for r in warc.read_pages(spark, path).collect())
    assert got == {(3, "response", None, True): 3, (4, "response", None, True): 2, (9, "revisit", 4, True): 4, (None, "response", None, True): 2}


@pytest.mark.parametrize("damage", ["torn", "flipped", "length", "page", "negative", "empty"])
def test_damaged_archives_give_a_fault_and_what_lies_before(spark, tmp_path, damage):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nWARC-Page-ID: %s\r\nContent-Length: %s\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
    good, other = gzip.compress(record % (1, b"1", b"22")), gzip.compress(record % (2, b"2", b"22"))
    bad = {
        "torn": other[:-20], "flipped": other[:30] + bytes(b ^ 255 for b in other[30:60]) + other[60:],
        "length": gzip.compress(record % (2, b"2", b"99999999999")), "page": gzip.compress(record % (2, b"x", b"22")),
        "negative": gzip.compress(record % (2, b"2", "\u00b2\u00b2".encode())), "empty": b"",
    }[damage]
    (tmp_path / "one.gz").write_bytes(good + bad)
    found = warc.read_records(spark, str(tmp_path)).collect()
    assert [r["record_id"] for r in found if r["fault"] is None] == ["<1>"]
    assert len([r for r in found if r["fault"]]) == (0 if damage == "empty" else 1)
    pages = warc.read_pages(spark, str(tmp_path)).collect()
    assert [(r["page_id"], r["payload_bytes"], r["record_type"]) for r in pages if r["page_id"] is not None] == [(1, 3, "response")]


@pytest.mark.parametrize("block, body", [
    (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\nA;x=y\r\n0123456789\r\n0\r\n\r\n", b"abc0123456789"),
    (b"HTTP/1.1 200 OK\r\n\r\nplain", b"plain"), (b"no head", None),
    (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc\r\n0\r\n\r\n", None),
    (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n", None),
])
def test_chunked_framing(block, body):
    assert warc.http_body(block) == body

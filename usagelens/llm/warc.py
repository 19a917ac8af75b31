"""WARC archives: writing pages as segmented, chunked records, and reassembling them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.sources.workspace import cut_lineage

# Fixed values of the WARC 1.1 and HTTP 1.1 formats.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

#: Records below this many payload bytes are never written as revisits.
REVISIT_BYTES = 100

RECORD_SCHEMA = (
    "record_id string, record_type string, page_id long, uri string, payload_digest string, refers_to_id string, "
    "origin_id string, segment_number int, total_length long, block binary, fault string"
)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    segment_bytes: int = 16_384, chunk_bytes: int = 4_096, records_per_file: int = 2_000,
    captured: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one record per page row into gzip archives under ``path``.

    The payload is the UTF-8 text, null as empty, inside an HTTP response in chunked transfer
    framing. Of the rows with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with
    the smallest id (then url; nulls last) is the response, and the others are revisits of it.
    A response block of more than ``segment_bytes`` bytes goes into a first segment and
    continuation records, which may lie in different archives. A record's id is a digest of
    page id, url and payload, so equal rows are written as copies of one record.

    Records are bounded, and an archive has ``records_per_file`` at most, so it can be read
    back in one piece whatever the size of the table or of a page.
    """
    page = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )
    page = page.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    copies = _first_of_copies(page)
    page = page.join(copies, ["digest", "bytes"], "left")
    page = page.withColumn("record_id", _record_id(F.col("page_id"), F.col("url"), F.col("digest")))
    page = page.withColumn("first_id", F.when(F.col("first").isNotNull(), _record_id(F.col("first.page_id"), F.col("first.url"), F.col("digest"))))
    again = F.coalesce(F.col("first_id") != F.col("record_id"), F.lit(False))
    # A column of its own, or each segment would frame the whole payload anew.
    page = page.withColumn("block", F.when(~again, _framed(chunk_bytes))).withColumn("block_bytes", F.octet_length("block"))
    lines = page.withColumn("record", F.explode(F.when(again, F.array(_revisit(captured))).otherwise(_responses(segment_bytes, captured))))
    (
        lines.select(F.col("record").cast("string").alias("value"))
        .write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    )


def _first_of_copies(page: DataFrame) -> DataFrame:
    """For every payload that occurs more than once: its first row. No payload is shuffled here."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url"))
    groups = page.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes")
    return groups.agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    part = F.md5(F.concat_ws("\x00", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(part, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p).cast("binary") if isinstance(p, str) else p.cast("binary") for p in parts])


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. Line breaks in a value become blanks."""
    line = F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n"))
    return F.coalesce(line, F.lit(""))


def _record(kind: Column, fields: list[Column], block: Column) -> Column:
    """A whole record but for the line feed that the text writer adds."""
    length = F.octet_length(block).cast("string")
    return _text(F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\n"), *fields,
        F.lit("Content-Length: "), length, F.lit("\r\n\r\n"),
    ), block, "\r\n\r")


def _common(captured: str) -> list[Column]:
    return [
        _field("WARC-Date", F.lit(captured)), _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Page-ID", F.col("page_id")), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
    ]


def _revisit(captured: str) -> Column:
    fields = [
        _field("WARC-Record-ID", F.col("record_id")), *_common(captured),
        _field("WARC-Profile", F.lit(REVISIT_PROFILE)), _field("WARC-Refers-To", F.col("first_id")),
        _field("WARC-Refers-To-Target-URI", F.col("first.url")),
    ]
    return _record(F.lit("revisit"), fields, F.lit(HTTP_HEAD).cast("binary"))


def _pieces(data: Column, size: int) -> Column:
    """Byte slices of at most ``size`` bytes; an empty text has none. Slicing bytes is constant time, unlike characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1)), F.lit(size))
    slices = F.transform(starts, lambda at: F.substring(data, at, F.lit(size)))
    return F.filter(slices, lambda piece: F.octet_length(piece) > 0)


def _framed(chunk_bytes: int) -> Column:
    """The HTTP response of a payload in chunked transfer framing."""
    chunks = F.transform(_pieces(F.col("payload"), chunk_bytes), lambda c: _text(
        F.concat(F.lower(F.hex(F.octet_length(c))), F.lit("\r\n")), c, "\r\n"
    ).cast("string"))
    return _text(HTTP_HEAD, F.array_join(chunks, ""), "0\r\n\r\n")


def _responses(segment_bytes: int, captured: str) -> Column:
    segments = _pieces(F.col("block"), segment_bytes)

    def record(piece: Column, index: Column) -> Column:
        number = index + 1
        cut = F.col("block_bytes") > segment_bytes
        origin = F.when(index > 0, F.col("record_id"))
        own = F.when(index > 0, _record_id(F.col("page_id"), F.concat_ws("#", F.col("url"), number), F.col("digest"))).otherwise(F.col("record_id"))
        last = number * segment_bytes >= F.col("block_bytes")
        return _record(F.when(index > 0, F.lit("continuation")).otherwise(F.lit("response")), [
            _field("WARC-Record-ID", own), *_common(captured),
            _field("WARC-Segment-Number", F.when(cut, number)), _field("WARC-Segment-Origin-ID", origin),
            _field("WARC-Segment-Total-Length", F.when(cut & last, F.col("block_bytes"))),
        ], piece)

    return F.transform(segments, record)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, one row each, with ``RECORD_SCHEMA``.

    Records are found by their lengths, never by searching the payload. What does not parse
    gives one row with ``fault`` set, and the rest of that archive is left.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_parse_batches, RECORD_SCHEMA)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()),
        ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("origin_id", pa.string()),
        ("segment_number", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary()), ("fault", pa.string()),
    ])
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for row in parse_archive(content.as_py()):
                rows.append(row)
                held += len(row.get("block") or b"")
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def parse_archive(content: bytes) -> Iterator[dict]:
    """Records of one archive, whose gzip members are unpacked as the reading goes on."""
    data, at = _Unpacked(content), 0
    try:
        while (head := data.until(b"\r\n\r\n")) is not None:
            fields = _header(head, VERSION)
            numbers = {k: _whole_number(fields.get(k)) for k in ("content-length", "warc-segment-number", "warc-segment-total-length", "warc-page-id")}
            length = numbers["content-length"]
            if length is None or any(v is None and fields.get(k) for k, v in numbers.items()):
                yield _fault(f"no record at {at}")
                return
            block, end = data.take(length), data.take(4)
            if len(block) < length or end != b"\r\n\r\n":
                yield _fault(f"the record at {at} is cut off")
                return
            at += len(head) + len(block) + 8
            yield {
                "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"),
                "page_id": numbers["warc-page-id"], "uri": fields.get("warc-target-uri"),
                "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
                "refers_to_id": fields.get("warc-refers-to"), "origin_id": fields.get("warc-segment-origin-id"),
                "segment_number": numbers["warc-segment-number"], "total_length": numbers["warc-segment-total-length"],
                "block": block, "fault": None,
            }
        if data.left():
            yield _fault(f"bytes without a record at {at}")
    except zlib.error as error:
        yield _fault(f"the archive does not unpack behind {at}: {error}")


def _fault(what: str) -> dict:
    return {"block": None, "fault": what}


def _whole_number(text: str | None) -> int | None:
    """A decimal of at most 18 digits, or None."""
    return int(text) if text and re.fullmatch("-?[0-9]{1,18}", text) else None


class _Unpacked:
    """Bytes of a gzip file of one or more members, a bounded part of them held at a time."""

    def __init__(self, content: bytes):
        self.rest, self.held, self.unzip = content, b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while self.rest or self.unzip.unconsumed_tail:
            part = self.unzip.decompress(self.unzip.unconsumed_tail or self._next(), 1 << 20)
            if self.unzip.eof:
                self.rest = self.unzip.unused_data + self.rest
                self.unzip = zlib.decompressobj(31)
            if part:
                self.held += part
                return True
        return False

    def _next(self) -> bytes:
        part, self.rest = self.rest[: 1 << 18], self.rest[1 << 18:]
        return part

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                return None
        found, self.held = self.held[:at], self.held[at + len(mark):]
        return found

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while need and (self.held or self._more()):
            parts.append(self.held[:need])
            need -= len(parts[-1])
            self.held = self.held[len(parts[-1]):]
        return b"".join(parts)

    def left(self) -> bool:
        return bool(self.held)


def _header(head: bytes, first: str) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0] != first:
        return {}
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit record: ``block``, ``intact`` and the header columns.

    Whole records stay where they are. Segments meet by the id of their first, go in order of
    their numbers, which must run from 1 without gap, and must add up to the total length that
    the last one states; otherwise ``intact`` is false and ``block`` null. A group is the
    segments of one record, never more. Segments of equal id and number are one; continuations without
    their first segment are one record of unknown page. Faults of the archives are rows too.
    Records of equal id, which equal rows of a table are written as, stay as many rows as were
    written: whole ones as they are, segmented ones as often as their first segment occurs.
    """
    whole = records.where("segment_number IS NULL").select(
        "record_id", "record_type", "page_id", "uri", "payload_digest", "refers_to_id", "block", F.col("fault").isNull().alias("intact"),
    )
    parts = records.where("segment_number IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment_number") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("origin").agg(
        *[first(c) for c in ("record_type", "page_id", "uri", "payload_digest", "refers_to_id")],
        F.max("total_length").alias("total"), F.greatest(F.lit(1), F.count_if(F.col("segment_number") == 1)).alias("copies"),
        F.array_sort(F.collect_set(F.struct("segment_number", F.col("block").alias("piece")))).alias("pieces"),
    )
    numbers = F.transform("pieces", lambda p: p["segment_number"])
    block = F.array_join(F.transform("pieces", lambda p: p["piece"].cast("string")), "").cast("binary")
    joined = joined.withColumn("block", block).withColumn(
        "intact",
        F.coalesce((numbers == F.sequence(F.lit(1), F.size("pieces"))) & (F.octet_length("block") == F.col("total")), F.lit(False)),
    )
    joined = joined.select(
        F.col("origin").alias("record_id"), "record_type", "page_id", "uri", "payload_digest", "refers_to_id",
        F.when(F.col("intact"), F.col("block")).alias("block"), "intact", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return whole.unionByName(joined.drop("copy"))


def decode_payloads(assembled: DataFrame) -> DataFrame:
    """Adds ``payload``: the HTTP body with its chunked transfer framing taken off, null if it does not decode."""
    schema = T.StructType([*assembled.schema.fields, T.StructField("payload", T.BinaryType())])
    place = assembled.columns.index("block")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [http_body(b.as_py()) if b.is_valid else None for b in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "payload"])

    return assembled.mapInArrow(decode, schema)


def http_body(block: bytes) -> bytes | None:
    """Body of an HTTP response, taken out of chunked framing if it says so. None if it is malformed."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    if not re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")):
        return body
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n: at + n + 2] != b"\r\n":
            return None
        parts.append(body[at: at + n])
        at += n + 2


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Every reassembled record with its decoded ``payload``; see ``reassemble`` and ``decode_payloads``."""
    return decode_payloads(reassemble(read_records(spark, path)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives: one row per record with its full payload's length and digest.

    ``page_id``, ``uri``, ``record_type``, ``refers_to`` (page of the response that a revisit
    names), ``payload_bytes``, ``payload_digest`` (both measured on the payload read back, a
    revisit's on that of its response), ``intact`` (all read, and as the digest in the header).
    Copies of a record, which equal rows of the table were written as, are a row each. The
    archives are read once; what goes on from there is some hundred bytes a record.
    """
    measured = read_payloads(spark, path).select(
        "record_id", "page_id", "uri", F.coalesce("record_type", F.lit("response")).alias("record_type"), "refers_to_id",
        F.col("payload_digest").alias("stated"), F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "intact",
    )
    measured = cut_lineage(measured)
    right = lambda digest: F.coalesce(F.col("intact") & (F.col(digest) == F.col("stated")), F.lit(False))
    responses = measured.where("record_type = 'response'")
    own = responses.select(
        "page_id", "uri", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest",
        right("payload_digest").alias("intact"),
    )
    # Copies of a response are one target.
    targets = responses.where("record_id IS NOT NULL").dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        F.col("payload_digest").alias("target_digest"), F.col("payload_bytes").alias("target_bytes"),
    )
    revisits = measured.where("record_type <> 'response'").join(targets, "refers_to_id", "left")
    return own.unionByName(revisits.select(
        "page_id", "uri", "record_type", "refers_to", F.col("target_bytes").alias("payload_bytes"),
        F.col("target_digest").alias("payload_digest"), right("target_digest").alias("intact"),
    ))

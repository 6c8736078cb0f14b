"""WARC archives: writing pages as records, and reassembling segmented records.

Writing. The payload is sent in chunks (``Transfer-Encoding: chunked``); a block longer than ``segment_bytes``
is cut into a first record and continuation records that name it (``WARC-Segment-Origin-ID``), are numbered, and
of which the last tells the total length. Of equal payloads of at least ``revisit_bytes`` one is a response and
the others are revisits without a body. Records are written by Spark's text writer with the blank lines that
end a record as line separator, gzipped per file; segment size and records per file bound what a file holds.

Reading. Each file is a stream of records. Segments that lie in one file are joined there; the others are
grouped by their origin and ordered by number. Only when the numbers run from 1 without a gap and the total
length is right are they taken for a record; then its chunked framing is decoded.

Defined results: a null html is an empty payload; a null url is left out; line ends in a url are percent-encoded. A
null page id names no page: such a page may be a revisit, but no other refers to it. Rows are records of their own,
also where an id comes back; of equal payloads all rows with the largest id are responses. Incomplete or wrongly
framed records are returned with ``complete`` false and no payload. An empty table gives no records. Other columns
are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonset.session import shared_folder

from .common import small_batches, table

SEGMENT_BYTES, CHUNK_BYTES, REVISIT_BYTES, FILE_RECORDS = 16 << 10, 4 << 10, 1000, 4096
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; none where the framing is wrong. Chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].partition(b";")[0].strip(), 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        if not size:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def page_records(page_id, url, html: str | None, digest: str, refers_to, segment_bytes: int) -> list[bytes]:
    """The records of one page, without the blank lines between records."""
    address = None if url is None else "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url)
    name = f"<urn:uuid:{uuid.uuid4()}>"
    common = {"WARC-Target-URI": address, "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id}
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = {"WARC-Type": "revisit", "WARC-Record-ID": name, "WARC-Profile": profile, **common, "X-Refers-To-Page-Id": refers_to}
        return [_record({**fields, "Content-Type": "application/http;msgtype=response"}, head)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked((html or "").encode())
    fields = {"WARC-Type": "response", "WARC-Record-ID": name, **common, "Content-Type": "application/http;msgtype=response"}
    if len(block) <= segment_bytes:
        return [_record(fields, block)]
    cuts = range(0, len(block), segment_bytes)
    out = [_record({**fields, "WARC-Segment-Number": 1}, block[:segment_bytes])]
    for number, start in enumerate(cuts[1:], 2):
        own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": number}
        total = len(block) if number == len(cuts) else None
        out.append(_record({**own, "WARC-Segment-Total-Length": total}, block[start : start + segment_bytes]))
    return out


def _records(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")))
            yield pa.RecordBatch.from_arrays([pa.array([r for row in rows for r in page_records(*row, segment_bytes)], pa.binary())], ["record"])

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    segment_bytes: int = SEGMENT_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
    file_records: int = FILE_RECORDS,
    columns: tuple[str, str, str] = ("page_id", "url", "html"),
) -> None:
    """Writes one record per page, segmented where long, below ``folder``."""
    page_id, url, html = columns
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    # Only digests and ids are grouped; a payload that is alone has no row here.
    equal = (
        rows.where(F.octet_length("html") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 AND kept IS NOT NULL")
    )
    decided = rows.join(equal.select("digest", "kept"), "digest", "left").withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("kept")), None).otherwise(F.col("kept")))
    records = decided.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_records(segment_bytes), "record binary")
    writer = records.select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", file_records).text(folder)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


_PARSED = pa.schema(
    [("origin", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("declared", pa.string())]
    + [("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("payload", pa.binary()), ("complete", pa.bool_())]
)
PARSED = "origin string, record_type string, page_id long, url string, refers_to long, declared string, number int, total long, block binary, payload binary, complete boolean"


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response; none where its framing is wrong."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def joined(segments: list[tuple[int, int | None, bytes]]) -> bytes | None:
    """The block of segments (number, total length, bytes): none unless they are whole."""
    segments = sorted(segments, key=lambda s: s[0])
    totals = {s[1] for s in segments if s[1] is not None}
    block = b"".join(s[2] for s in segments)
    whole = [s[0] for s in segments] == list(range(1, len(segments) + 1)) and totals == {len(block)}
    return block if whole else None


def _number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def _row(fields: dict[str, str], block: bytes) -> dict:
    digest = fields.get("warc-payload-digest", "")
    return {
        "origin": fields.get("warc-segment-origin-id") or fields.get("warc-record-id"),
        "record_type": fields.get("warc-type"),
        "page_id": _number(fields.get("x-page-id")),
        "url": fields.get("warc-target-uri"),
        "refers_to": _number(fields.get("x-refers-to-page-id")),
        "declared": digest.partition(":")[2] or None,
        "number": _number(fields.get("warc-segment-number")),
        "total": _number(fields.get("warc-segment-total-length")),
        "block": block,
    }


def _read_files(with_payload: bool):
    def finished(row: dict, block: bytes) -> dict:
        payload = payload_of(block) if row["record_type"] != "revisit" else b""
        return {**row, "number": None, "total": None, "block": None, "complete": payload is not None, "payload": payload}

    def rows_of(stream) -> Iterator[dict]:
        waiting: dict[str, list[dict]] = defaultdict(list)
        for fields, block in parse(stream):
            row = _row(fields, block)
            if row["record_type"] not in ("response", "revisit", "continuation"):
                continue
            if row["number"] is None:
                yield finished(row, block)
                continue
            parts = waiting[row["origin"]]
            parts.append(row)
            total = next((p["total"] for p in parts if p["total"] is not None), None)
            if total is not None and sum(len(p["block"]) for p in parts) == total:
                whole = joined([(p["number"], p["total"], p["block"]) for p in parts])
                first = next((p for p in parts if p["number"] == 1), None)
                if whole is not None and first is not None:
                    del waiting[row["origin"]]
                    yield finished(first, whole)
        for parts in waiting.values():
            yield from ({**p, "complete": False, "payload": None} for p in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                data = content.as_buffer()
                raw = pa.BufferReader(data)
                stream = gzip.GzipFile(fileobj=raw) if data[:2].to_pybytes() == b"\x1f\x8b" else raw
                for row in rows_of(io.BufferedReader(stream, 1 << 20) if isinstance(stream, gzip.GzipFile) else io.BytesIO(data)):
                    if row["complete"] and not with_payload:
                        row = _digested(row)
                    held.append(row)
                    size += len(row["block"] or b"") + len(row["payload"] or b"")
                    if size > 4 << 20 or len(held) >= 2000:
                        yield pa.RecordBatch.from_pylist(held, schema=_schema(with_payload))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_schema(with_payload))

    return run


def _schema(with_payload: bool) -> pa.Schema:
    return _PARSED if with_payload else pa.schema([*_PARSED, ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _digested(row: dict) -> dict:
    return {**row, "payload": None, "payload_bytes": len(row["payload"]), "payload_digest": hashlib.sha1(row["payload"], usedforsecurity=False).hexdigest()}


def _rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the segments of records that lay in several files."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            parts = row.pop("parts")
            if parts:
                block = joined([(p["number"], p["total"], p["block"]) for p in parts])
                payload = payload_of(block) if block is not None else None
                row |= {"payload": payload, "complete": payload is not None}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([f for f in batch.schema if f.name != "parts"]))


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record: ``origin`` (its id), type, page id, url, ``refers_to``, declared digest, ``payload``, ``complete``.

    Without payloads, their lengths and SHA-1 are returned instead (``payload_bytes``, ``payload_digest``).
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    more = "" if with_payload else ", payload_bytes long, payload_digest string"
    rows = files.mapInArrow(_read_files(with_payload), PARSED + more)
    # A record's own fields stand in its first segment; most rows here are whole and carry no bytes.
    first = lambda c: F.max(F.when(F.coalesce("number", F.lit(1)) == 1, F.col(c))).alias(c)
    names = ["record_type", "page_id", "url", "refers_to", "declared", "payload"] + ([] if with_payload else ["payload_bytes", "payload_digest"])
    part = F.when(F.col("number").isNotNull(), F.struct("number", "total", "block"))
    whole = rows.groupBy("origin").agg(*[first(c) for c in names], F.max("complete").alias("complete"), F.collect_list(part).alias("parts"))
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema.fields if f.name != "parts"}
    out = whole.mapInArrow(_rejoin, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    if with_payload:
        return out
    late = F.col("payload").isNotNull()
    return out.withColumns(
        {"payload_bytes": F.when(late, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")), "payload_digest": F.when(late, F.sha1("payload")).otherwise(F.col("payload_digest"))}
    ).drop("payload")


def resolved(records: DataFrame) -> DataFrame:
    """Gives revisits the length and digest of the response they repeat; null where it is missing."""
    responses = records.where("record_type = 'response' AND complete").groupBy(F.col("payload_digest").alias("declared")).agg(F.max("payload_bytes").alias("of_bytes"))
    revisits = records.where("record_type = 'revisit'").join(responses, "declared", "left")
    revisits = revisits.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.when(F.col("of_bytes").isNotNull(), F.col("declared")).alias("payload_digest"), "record_type", "refers_to")
    rest = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return rest.union(revisits)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reasonset.session import saved_once

    folder = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return resolved(saved_once(read_archives(spark, folder, with_payload=False), "records"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""

"""Operator 4, WARC archives with segment reassembly.

Writing: every page becomes a response record, an HTTP message whose body is in chunked transfer framing, or a revisit
record that refers to the response with an equal payload. A response block longer than a segment is cut into a first
record and continuation records with WARC-Segment-Number, WARC-Segment-Origin-ID and, on the last, the total length.
Spark's text writer puts the records into files; its line separator is the record separator of the format.

Reading: a file's compressed bytes are one row; they are inflated piece by piece and parsed record by record by their
Content-Length, so a task holds one compressed file and a record at a time, not the file's content. Continuation records are grouped by the record
they continue, ordered by segment number and checked against the total length; the HTTP head is split off, chunked
framing is decoded, and the payload's digest is checked. Records of one origin are few and bounded by one page, and
only segmented records are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

RECORD = "page_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, segment int, total long, url string, block binary, path string"
_BREAK = "\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([payload_digest(b) for b in bodies], pa.string()), pa.array([len(b) for b in bodies], pa.int64())], names=["page_id", "payload_digest", "payload_bytes"])


def chunked(body: bytes, size: int) -> bytes:
    """The body in chunked transfer framing."""
    out = [b"%x\r\n%s\r\n" % (len(x), x) for x in _segments(body, size) if x]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(framed[end + 2 : end + 2 + n])
        if framed[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        at = end + 4 + n


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + _BREAK).encode()


def _records(segment_bytes: int, chunk_bytes: int):
    """Rows (page_id, url, html, digest, refers_to) to WARC records without their closing separator."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                body = (html or "").encode("utf-8", "surrogatepass")
                uri = re.sub(r"[\x00-\x20]", "%20", url or "")
                fields = [("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{payload_digest(body)}")]
                if uri:
                    fields.append(("WARC-Target-URI", uri))
                if refers is not None:
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    fields += [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(head))]
                    out.append(_head(fields) + head)
                    continue
                message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body, chunk_bytes)
                parts = _segments(message, segment_bytes)
                fields += [("WARC-Type", "response"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(parts[0]))]
                out.append(_head(fields + [("WARC-Segment-Number", 1)] * (len(parts) > 1)) + parts[0])
                for i, part in enumerate(parts[1:], 2):
                    more = [("WARC-Record-ID", f"<urn:page:{page}:segment:{i}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", f"<urn:page:{page}>"), ("WARC-Segment-Number", i), ("Content-Length", len(part))]
                    out.append(_head(more + [("WARC-Segment-Total-Length", len(message))] * (i == len(parts))) + part)
            yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "surrogatepass") for x in out], pa.string())], names=["value"])

    return run


def _segments(message: bytes, size: int) -> list[bytes]:
    """Cuts of at most size bytes, at the start of a character, as records are written as text."""
    out, at = [], 0
    while len(message) - at > size:
        end = at + size
        while message[end] & 0xC0 == 0x80:
            end -= 1
        out.append(message[at:end])
        at = end
    return out + [message[at:]]


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = 32_768, chunk_bytes: int = 8_192, file_records: int = 20_000) -> None:
    """Writes one record per page (page_id long, url, html) into WARC files under path, by Spark's writer.

    Of pages with equal payloads of at least least_bytes bytes the one with the smallest page_id is written as a
    response, the others as revisits that refer to it; shorter payloads are all responses. A null html is an empty
    payload. page_id must be there and unique: rows without one are left out, of rows that repeat one the smallest
    (url, html) is written. A file holds what one task writes, file_records records at most.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").filter("page_id is not null")
    seen = pages.select("page_id", "html").mapInArrow(_digests, "page_id long, payload_digest string, payload_bytes long")
    if seen.count() != seen.select("page_id").distinct().count():
        pages = pages.groupBy("page_id").agg(F.min(F.struct("url", "html")).alias("x")).select("page_id", "x.url", "x.html")
        seen = pages.select("page_id", "html").mapInArrow(_digests, "page_id long, payload_digest string, payload_bytes long")
    seen = seen.filter(F.col("payload_bytes") >= least_bytes)
    first = seen.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = seen.join(first, "payload_digest").filter("page_id <> refers_to").select("page_id", "refers_to")
    rows = pages.join(again, "page_id", "left").select("page_id", "url", "html", "refers_to")
    rows.mapInArrow(_records(segment_bytes, chunk_bytes), "value string").write.option("maxRecordsPerFile", file_records).option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def inflated(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The content of a file piece by piece: gzip members one after the other, or the bytes as they are."""
    at, z = 0, None
    while at < len(data):
        if z is None:
            if data[at : at + 2] != b"\x1f\x8b":
                yield data[at:]
                return
            z = zlib.decompressobj(31)
        piece = data[at : at + step]
        out = z.decompress(piece)
        at += len(piece) - len(z.unused_data)
        if out:
            yield out
        if z.eof:
            z = None
    if z is not None:
        raise ValueError("a compressed file is cut off")


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file whose content comes in pieces."""
    held, at, over = bytearray(), 0, False

    def until(ready) -> None:
        nonlocal over
        while not over and not ready():
            piece = next(pieces, None)
            over = piece is None
            held.extend(piece or b"")

    while True:
        until(lambda: held.find(b"\r\n\r\n") >= 0)
        end = held.find(b"\r\n\r\n")
        if not held:
            return
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        last = end + 4 + int(fields["content-length"])
        until(lambda: len(held) >= last + 4)
        if held[last : last + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield fields, bytes(held[end + 4 : last])
        at += last + 4
        del held[: last + 4]


def _id(value: str | None) -> str | None:
    return re.sub(r"^<urn:page:|>$", "", value) if value else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for path, content in ((p, v) for batch in batches for p, v in zip(batch.column(0).to_pylist(), batch.column(1))):
        for f, block in parse_records(inflated(content.as_py())):
            origin = f.get("warc-segment-origin-id")
            digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
            rows.append((_id(origin or f["warc-record-id"]), f["warc-type"], _id(f.get("warc-refers-to")), digest, None, int(f["warc-segment-number"]) if "warc-segment-number" in f else None,
                         int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f.get("warc-target-uri"), block, path))
            size += len(block)
            if size > 8 << 20:
                yield _rows(rows)
                rows, size = [], 0
    yield _rows(rows)


def _rows(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) if rows else [[]] * 10, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole HTTP messages to payloads, checked against their digests."""
    for batch in batches:
        bodies, digests, kinds = [], [], []
        for kind, digest, blocks in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(5)):
            head, _, body = b"".join(blocks.as_py()).partition(b"\r\n\r\n")
            if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head):
                body = unchunked(body)
            bodies.append(body if kind == "response" else None)
            digests.append(digest if kind == "revisit" else payload_digest(body))
            if kind == "response" and digest and digest != digests[-1]:
                raise ValueError("a payload doesn't match its record's digest")
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.string()), batch.column(4), pa.array(bodies, pa.binary())], names=["page_id", "record_type", "refers_to", "payload_digest", "url", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, url, payload) of each page in the archives under path.

    Segmented records are put together again; a record whose segments are missing, doubled or of another total length
    than stated, a broken chunk or a wrong digest fails the job. The payload of a revisit is null. Files are
    plain or of one or many gzip members; a compressed file of 2 GB or more is beyond what Spark reads as one row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    records = files.mapInArrow(_parse, RECORD)
    whole = records.filter("segment is null").select("page_id", "record_type", "refers_to", "payload_digest", "url", F.array("block").alias("blocks"))
    part = F.struct("segment", "block", "total", "record_type", "payload_digest", "url")
    joined = records.filter("segment is not null").groupBy("page_id").agg(F.array_sort(F.collect_list(part)).alias("s"))
    joined = joined.withColumn("total", F.element_at("s", -1)["total"])
    length = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.length(x["block"]))
    broken = (F.size("s") != F.element_at("s", -1)["segment"]) | F.col("total").isNull() | (length != F.col("total"))
    blocks = F.transform("s", lambda x: x["block"])
    joined = joined.withColumn("blocks", F.when(broken, F.raise_error(F.concat(F.lit("segments of record "), F.col("page_id"), F.lit(" are not whole")))).otherwise(blocks))
    first = F.element_at("s", 1)
    joined = joined.select("page_id", first["record_type"].alias("record_type"), F.lit(None).cast("string").alias("refers_to"), first["payload_digest"].alias("payload_digest"), first["url"].alias("url"), "blocks")
    return whole.unionByName(joined).mapInArrow(_payloads, "page_id string, record_type string, refers_to string, payload_digest string, url string, payload binary")


def round_trip(pages: DataFrame, path: str, **options) -> DataFrame:
    """Writes pages to path, reads the archives back and returns page_id, payload_bytes, payload_digest, record_type,
    refers_to per page. A revisit's length is that of the response it refers to, found by its id."""
    write_warc(pages, path, **options)
    back = read_warc(pages.sparkSession, path).select(F.col("page_id").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("n"), "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
    back = cut(back, shared_dir(pages.sparkSession), "read-back")
    revisits = back.filter("record_type = 'revisit'")
    sizes = back.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("n").alias("m"))
    revisits = revisits.join(sizes, "refers_to", "left").select("page_id", F.col("m").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return back.filter("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to").unionByName(revisits)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc")


_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages),
d as (select *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), 'string_agg', '') as payload_digest from p),
f as (select *, min(page_id) over (partition by h) as first_id from d)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to from f
"""
QUERIES = {"op4_warc": op4_warc}
ORACLE = {"op4_warc": _SQL}

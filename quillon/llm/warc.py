"""WARC archives: write a record per page, and read archives back with segment reassembly.

Payloads go out as HTTP responses in chunked transfer framing. A record whose block is longer than `SEGMENT` is split
into a first record and continuation records, which name it by WARC-Segment-Origin-ID. Records are written by Spark's
text writer, whose line separator is the end of a record, so archives land on any file system that Spark can write;
each file holds a bounded number of records of bounded size. Reading parses whole files record by record; only
segmented records are shuffled, grouped by origin, ordered by number, joined, held against their total length, and
then decoded like the others.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, read_table, shared_dir, stored

#: Bytes of a record's block, records of a file, bytes of a chunk, and the least payload that is not repeated.
SEGMENT = 16_384
FILE_RECORDS = 2_000
CHUNK = 4_096
LEAST = 100
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Decode chunked framing; raises ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def _record_id(page: int | None, digest: str, copy: int = 1, part: int = 1) -> str:
    """Rows may share a page_id, or have none, and the payload; so each has a copy number of its own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page}/{digest}/{copy}/{part}')}>"


def _record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n"  # the writer adds the last \r\n


def page_records(page: int | None, url: str | None, payload: bytes, refers: int | None, segment: int = SEGMENT, copy: int = 1, refers_copy: int = 1) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations. A revisit refers to the
    copy `refers_copy` of page `refers`. A page without an id has no X-Page-ID."""
    digest = hashlib.sha256(payload).hexdigest()
    base = {
        "WARC-Target-URI": "".join((url or "about:blank").split()),
        "WARC-Date": _DATE,
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if page is not None:
        base["X-Page-ID"] = str(page)
    if refers is not None:
        more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _record_id(refers, digest, refers_copy), "X-Refers-To-Page": str(refers)}
        return [_record({"WARC-Type": "revisit", "WARC-Record-ID": _record_id(page, digest, copy)} | base | more, b"")]
    block = _HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for k, part in enumerate(parts, 1):
        head = {"WARC-Type": "response" if k == 1 else "continuation", "WARC-Record-ID": _record_id(page, digest, copy, k)} | base
        if k == 1:
            head["Content-Type"] = "application/http; msgtype=response"
        else:
            head["WARC-Segment-Origin-ID"] = _record_id(page, digest, copy)
        if len(parts) > 1:
            head["WARC-Segment-Number"] = str(k)
        if 1 < len(parts) == k:
            head["WARC-Segment-Total-Length"] = str(len(block))
        out.append(_record(head, part))
    return out


def parsed(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    raw, at = bytes(data), 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        at = end + 4
        n = int(headers["content-length"])
        yield headers, raw[at : at + n]
        at += n
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at += 4


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(column(b, n).to_pylist() for n in ("page_id", "url", "html", "refers_to", "copy", "refers_copy")))
        for page, url, html, refers, copy, of in rows:
            yield pa.RecordBatch.from_arrays([pa.array(page_records(page, url, (html or "").encode(), refers, copy=copy, refers_copy=of), pa.binary())], ["record"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the small batches of one page into batches of some megabytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size > 4 << 20:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def numbered(pages: DataFrame) -> DataFrame:
    """page_id, url, html, the payload's digest, and a number `copy` of each row."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.sha2(_payload(), 256).alias("digest"), F.monotonically_increasing_id().alias("copy"),
    )


def revisits(rows: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to, refers_copy) of payloads, of at least 100 bytes, that a row with an earlier page_id
    has."""
    keys = rows.where((F.octet_length(_payload()) >= LEAST) & F.col("page_id").isNotNull()).select("page_id", "digest", "copy")
    first = keys.groupBy("digest").agg(F.min(F.struct("page_id", "copy")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.copy").alias("refers_copy"))
    return keys.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to", "refers_copy").distinct()


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record (or its segments) per row of pages. Null html is an empty payload; rows without a page_id stay
    so, are all responses, and nothing refers to them. Rows of the same page_id and payload have records of their own
    each; an empty table writes no records."""
    rows = numbered(pages)
    # Rows without a page_id find nothing; a key of their own each spreads them.
    own = F.when(F.col("page_id").isNull(), F.col("copy") + 1).otherwise(0)
    found = revisits(rows).withColumn("own", F.lit(0).cast("long"))
    rows = rows.withColumn("own", own).join(found, ["page_id", "digest", "own"], "left").drop("digest", "own")
    records = rows.mapInArrow(lambda batches: _gathered(_write(batches)), "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _decoded(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_RAW = pa.schema([("page_id", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    for b in batches:
        for content in column(b, "content"):
            data = content.as_buffer()
            data = gzip.decompress(data) if bytes(data[:2]) == b"\x1f\x8b" else data
            rows = []
            for h, block in parsed(data):
                number = int(h.get("warc-segment-number", 0))
                total = h.get("warc-segment-total-length")
                refers = h.get("x-refers-to-page")
                page = h.get("x-page-id")
                rows.append((page and int(page), h["warc-type"], h["warc-record-id"], h.get("warc-segment-origin-id", h["warc-record-id"]), number, total and int(total), refers and int(refers), h.get("warc-payload-digest", "").removeprefix("sha256:"), block))
            for i in range(0, len(rows), 500):
                part = list(zip(*rows[i : i + 500]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _RAW)], schema=_RAW)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "type", "refers_to", "digest", "payload"]
    for b in batches:
        payload = [_decoded(x) if t == "response" else None for t, x in zip(column(b, "type").to_pylist(), column(b, "block").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(column(b, n) for n in names[:4]), pa.array(payload, pa.binary())], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, type (response or revisit), refers_to, stated digest and payload of each record, segments joined.

    Segmented records must be complete: numbers 1..n, with the total length that the last one states; what is not
    comes back as type 'incomplete' without a payload.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    raw = files.mapInArrow(_read, "page_id long, type string, record_id string, origin string, segment int, total long, refers_to long, digest string, block binary")
    whole = raw.where("segment = 0").select("page_id", "type", "refers_to", "digest", "block")
    parts = raw.where("segment > 0").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), F.min("page_id").alias("page_id"), F.min("digest").alias("digest"), F.count("*").alias("n"), F.max("segment").alias("last")
    )
    block = F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.block))")
    joined = parts.withColumn("block", block)
    good = (F.col("n") == F.col("last")) & (F.octet_length("block") == F.col("total"))
    joined = joined.select("page_id", F.when(good, "response").otherwise("incomplete").alias("type"), F.lit(None).cast("long").alias("refers_to"), "digest", "block")
    return whole.unionByName(joined).mapInArrow(_payloads, "page_id long, type string, refers_to long, digest string, payload binary")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back: page_id, payload_bytes, payload_digest,
    record_type and refers_to, a row for each row of pages.

    Null html is an empty payload; a null page_id comes back null; repeated rows come back as often as they are there;
    of records that tie for the first of their payload (same page_id) all are responses; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return indexed(read_archives(spark, path))


def indexed(records: DataFrame) -> DataFrame:
    """A revisit takes length and digest from the response that it refers to, of the digest that it states. Length and
    digest of an incomplete record, and of a revisit without a complete response, are null."""
    found = records.select("page_id", "type", "refers_to", F.col("digest").alias("stated"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    found = stored(found, "warc-index")
    own = found.where("type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    origin = found.where("type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"))
    origin = origin.agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    again = found.where("type = 'revisit'").select("page_id", "refers_to", "stated", F.col("type").alias("record_type")).join(origin, ["refers_to", "stated"], "left").drop("stated")
    return own.unionByName(again)


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over all pages; nulls, ties and empty tables as in archived_pages()."""
    return archived_pages(read_table(spark, sf_dir, "pages"))


QUERIES = {"op5_warc_segments": op5_warc_segments}

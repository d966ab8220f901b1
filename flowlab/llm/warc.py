"""WARC archives: writing pages with revisits and segments, and reassembling what is read.

Archive files are written by Spark's text writer with the record end as line separator, so
they are whole gzip-compressed WARC files on whatever store the folder is on. Reading
parses each file (bounded by the records the writer puts in one), then groups continuation
records by origin identifier, orders them by segment number, verifies the total length, and
decodes chunked transfer framing.

Cases: a null html is an empty payload, null ids sort last and stay null, a null or odd url
is left out or percent-encoded. Rows repeating a page_id and its payload are each a response
if that page_id is the payload's smallest, else each a revisit. Repeated segments count
once; segments that are missing, differ, or do not add up to the total length give one row
with status "incomplete" and no payload, and are never gathered. An empty table gives
no archives and no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.session import fresh_path, materialise

#: Block bytes of one record; longer blocks continue in further records.
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4096
#: So a file has at most this many times SEGMENT_BYTES plus headers.
RECORDS_PER_FILE = 2048
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing breaks."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        parts.append(body[at : at + size])
        at += size + 2


def _record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    head += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + END).encode() + block


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def page_records(row: int, page_id: int | None, url: str | None, payload: bytes | None, digest: str, first: int | None, revisit: bool, segment: int) -> list[bytes]:
    """The records of one page: a revisit, or a response in as many segments as it takes."""
    header = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    own = _urn(page_id, digest, row)
    fields = {
        "WARC-Record-ID": own,
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url is not None else None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Page-ID": None if page_id is None else str(page_id),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "Refers-To-Page-ID": None if first is None else str(first)}
        return [_record("revisit", fields, header)]
    block = header + chunked(payload)
    if len(block) <= segment:
        return [_record("response", fields, block)]
    parts = [block[a : a + segment] for a in range(0, len(block), segment)]
    out = [_record("response", fields | {"WARC-Segment-Number": "1"}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = {"WARC-Record-ID": _urn(page_id, digest, row, k), "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": str(k)}
        more |= {"WARC-Segment-Total-Length": str(len(block))} if k == len(parts) else {}
        out.append(_record("continuation", more, part))
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Write every row of ``pages`` (page_id, url, html) as WARC records under ``path``.

    Of equal payloads the one with the smallest page_id is a response, the others revisit it.
    Only digests are grouped; payloads move only to meet the table of digests that occur
    more than once, and stay where they are while that table is small enough to broadcast.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"))
    copied = rows.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    copied = copied.where("first < last").select("digest", F.col("first.page_id").alias("first"), F.lit(True).alias("copied"))
    joined = rows.join(materialise(copied, "copied"), "digest", "left")
    revisit = F.col("copied").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = joined.select(
        "page_id", "url", "digest", "first", revisit.alias("revisit"), F.when(~revisit, F.col("payload")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    digest = base32(r["digest"])
                    out += page_records(r["row"], r["page_id"], r["url"], r["payload"], digest, r["first"], r["revisit"], segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.text(path)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of a WARC file."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {stop}")
        yield fields, data[start:stop]
        at = stop + 4


PARSED = (
    "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_digest string, "
    "number int, origin string, total long, block binary"
)


def parsed(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """The records of all files under ``path``: those of segmented records, or all others."""

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in PARSED.split(", "))]
        )
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in records_of(content.as_py()):
                    if ("warc-segment-number" in f) != segmented:
                        continue
                    rows.append((
                        f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), number(f.get("page-id")),
                        number(f.get("refers-to-page-id")), f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        number(f.get("warc-segment-number")), f.get("warc-segment-origin-id", f["warc-record-id"]),
                        number(f.get("warc-segment-total-length")), block,
                    ))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, PARSED)


FIELDS = ["record_id", "record_type", "target_uri", "page_id", "refers_to", "payload_digest"]


def reassembled(segments: DataFrame) -> DataFrame:
    """One row per origin of segmented records, with its whole block, or null where it is incomplete.

    Lengths are verified on counts first, so that only blocks that add up are gathered, and
    one group never exceeds the record it makes.
    """
    size, check = F.octet_length("block"), F.sha1("block")
    one = segments.groupBy("origin", "number").agg(
        F.max(size).alias("size"), (F.min(check) == F.max(check)).alias("same"), F.max("total").alias("total")
    )
    whole: Column = (F.min("number") == 1) & (F.max("number") == F.count("*")) & (F.sum("size") == F.max("total")) & F.min("same")
    verdict = materialise(one.groupBy("origin").agg(F.coalesce(whole, F.lit(False)).alias("whole")), "verdict")
    parts = segments.join(verdict.where("whole"), "origin")
    blocks = parts.groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in FIELDS],
    )
    blocks = blocks.select(*FIELDS, F.expr("aggregate(parts.block, cast('' as binary), (a, b) -> concat(a, b))").alias("block"))
    broken = segments.join(verdict.where("not whole"), "origin").groupBy("origin").agg(
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in FIELDS]
    )
    broken = broken.withColumn("record_id", F.coalesce("record_id", "origin"))
    return blocks.union(broken.select(*FIELDS, F.lit(None).cast("binary").alias("block")))


def decoded(records: DataFrame) -> DataFrame:
    """Blocks to payloads: the HTTP header goes, chunked framing is decoded, the digest verified."""

    def payload(kind: str | None, digest: str | None, block: bytes | None) -> tuple[bytes | None, str]:
        if block is None:
            return None, "incomplete"
        if kind == "revisit":
            return None, "ok"
        try:
            end = block.index(b"\r\n\r\n")
            head, body = block[:end].lower(), block[end + 4 :]
            if b"\r\ntransfer-encoding: chunked" in head:
                body = unchunked(body)
        except ValueError:
            return None, "bad framing"
        if digest and base32(hashlib.sha1(body).hexdigest()) != digest:
            return body, "digest differs"
        return body, "ok"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [payload(k.as_py(), d.as_py(), b.as_py()) for k, d, b in zip(*map(batch.column, ("record_type", "payload_digest", "block")), strict=True)]
            new = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in FIELDS), *new], [*FIELDS, "payload", "status"])

    schema = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_digest string, payload binary, status string"
    return records.select(*FIELDS, "block").mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path`` with their payloads (null for revisits) and a status each."""
    single = parsed(spark, path, segmented=False).select(*FIELDS, "block")
    segments = materialise(parsed(spark, path, segmented=True), "segments")
    return decoded(single.union(reassembled(segments)))


def page_digests(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, status) of each record.

    A revisit has the length of the response with its digest.
    """
    small = read_archives(spark, path).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "status"
    )
    small = materialise(small, "records")
    full = small.where("record_type = 'response'")
    lengths = materialise(full.groupBy("payload_digest").agg(F.max("payload_bytes").alias("bytes")), "lengths")
    revisits = small.where("record_type = 'revisit'").drop("payload_bytes").join(lengths, "payload_digest", "left")
    return full.union(revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "status"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return page_digests(pages.sparkSession, path)

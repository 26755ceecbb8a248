"""WARC archives: written from pages, read back, and assembled into captures.

Every page becomes a transaction of three records: the request, the response
(or a revisit of an equal payload that was captured elsewhere) and metadata.
The latter two name the first through WARC-Concurrent-To. Archives are written
and read by Spark's own sources, so any store that Spark reaches will do; a
record ends where its Content-Length says, whatever its payload looks like.

Defined cases: a null html is an empty payload, a null url leaves out
WARC-Target-URI, a null page id leaves out the page-id field; of equal payloads
the largest page id is the response, among repeated rows of that id the last
one read; repeated rows are captures of their own; an empty table gives an
empty archive and no captures; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paywarden.llm.common import written
from paywarden.session import scratch_path

#: Format version, line end, base32 alphabet, and the date of all records.
VERSION, CRLF = "WARC/1.1", "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
#: Pages per archive: bounds what a reading task holds.
PAGES_PER_ARCHIVE = 4000


def base32(hex_digest: Column) -> Column:
    """A hexadecimal SHA-1 in base32: five digits make four letters."""
    letters = []
    for start in range(1, 41, 5):
        bits = F.conv(F.substring(hex_digest, start, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def staged(pages: DataFrame) -> DataFrame:
    """Pages with a row number and the digest of their payload, written so that both stay the same."""
    payload = F.coalesce("html", F.lit(""))
    return written(
        pages.select(
            "page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row_no"),
            base32(F.sha1(payload.cast("binary"))).alias("digest"),
        ),
        "pages",
    )


def record_id(kind: str, row_no: Column) -> Column:
    return F.concat(F.lit(f"<urn:{kind}:"), row_no.cast("string"), F.lit(">"))


def record(kind: Column | str, own_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the blank lines that end it; a header without value is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", F.lit(DATE)), *headers,
              ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields]
    return F.concat(F.lit(VERSION + CRLF), *lines, F.lit(CRLF), block)


def records(pages: DataFrame) -> DataFrame:
    """All records as text, one row each."""
    rows = staged(pages)
    latest = rows.groupBy(F.col("digest").alias("own")).agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))), "row_no")).alias("top"))
    joined = rows.join(latest, F.col("digest") == F.col("own"))
    number, first = F.col("row_no"), F.col("top.row_no")
    again = number != first
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    request, capture = record_id("request", number), record_id("capture", number)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("payload").cast("string"), F.lit(CRLF * 2),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    notes = F.concat(
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
        F.lit("payload-bytes: "), F.octet_length("payload").cast("string"), F.lit(CRLF),
    )
    target, joint = ("WARC-Target-URI", uri), ("WARC-Concurrent-To", request)
    three = F.array(
        record("request", request, [target, ("Content-Type", F.lit("application/http;msgtype=request"))], asked),
        record(
            F.when(again, "revisit").otherwise("response"), capture,
            [target, joint, ("Content-Type", F.lit("application/http;msgtype=response")),
             ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
             ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
             ("WARC-Refers-To", F.when(again, record_id("capture", first)))],
            F.when(again, http).otherwise(F.concat(http, "payload")),
        ),
        record("metadata", record_id("metadata", number), [target, joint, ("Content-Type", F.lit("application/warc-fields"))], notes),
    )
    return joined.select(F.explode(three).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Gzipped archives under a folder, each with a bounded number of pages."""
    writer = records(pages).write.option("lineSep", CRLF * 2).option("compression", "gzip")
    writer.option("maxRecordsPerFile", 3 * PAGES_PER_ARCHIVE).text(path)


def inflate(data: bytes) -> bytes:
    """A gzip file of one or more members."""
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def parse(archive: bytes) -> Iterator[dict]:
    """The records of one archive, by their Content-Length."""
    at = 0
    while (at := archive.find(b"WARC/", at)) >= 0:
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        at = end + 4 + int(headers["content-length"])
        yield headers | {"block": archive[end + 4:at]}


def payload_of(block: bytes) -> bytes:
    """What follows the header of an HTTP message."""
    return block.partition(b"\r\n\r\n")[2]


RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
    ("uri", pa.string()), ("declared_digest", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
])
LAYOUT = (
    "record_id string, record_type string, concurrent_to string, refers_to string, uri string, declared_digest string, "
    "payload_digest string, payload_bytes bigint, payload binary, fields map<string,string>"
)


def row_of(item: dict, payloads: bool) -> dict:
    kind, block = item["warc-type"], item["block"]
    row = {
        "record_id": item["warc-record-id"], "record_type": kind, "concurrent_to": item.get("warc-concurrent-to"),
        "refers_to": item.get("warc-refers-to"), "uri": item.get("warc-target-uri"),
        "declared_digest": item.get("warc-payload-digest", "").removeprefix("sha1:") or None,
    }
    if kind == "response":
        payload = payload_of(block)
        row |= {"payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload_bytes": len(payload)}
        row |= {"payload": payload} if payloads else {}
    elif kind == "metadata":
        fields = (line.partition(": ") for line in block.decode("utf-8").split("\r\n") if line)
        row["fields"] = [(name, value) for name, _, value in fields]
    return row


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder; without ``payloads`` only their digests and sizes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for item in parse(inflate(content.as_py())):
                    rows.append(row_of(item, payloads))
                    held += len(item["block"])
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(read, LAYOUT)


def captures(found: DataFrame) -> DataFrame:
    """One row per capture: its request, response or revisit, and metadata, each nested.

    The three meet on the id of the request. A revisit takes digest and size of
    its payload from the response that it refers to.
    """
    kind = F.col("record_type")
    requests = found.where(kind == "request").select("record_id", F.struct("uri").alias("request"))
    metadata = found.where(kind == "metadata").select(
        F.col("concurrent_to").alias("record_id"), F.struct("fields").alias("metadata")
    )
    answers = found.where(kind.isin("response", "revisit"))
    original = found.where(kind == "response").select(
        F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("old_digest"), F.col("payload_bytes").alias("old_bytes")
    )
    content = answers.join(original, "refers_to", "left").select(
        F.col("concurrent_to").alias("record_id"),
        F.struct(
            F.col("record_id").alias("capture_id"), "record_type", "refers_to", "declared_digest",
            F.coalesce("payload_digest", "old_digest").alias("payload_digest"),
            F.coalesce("payload_bytes", "old_bytes").alias("payload_bytes"), "payload",
        ).alias("response"),
    )
    return content.join(requests, "record_id", "left").join(metadata, "record_id", "left")


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page what its archive says: page_id, payload_bytes, payload_digest, record_type, refers_to, uri."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    found = written(read_archives(pages.sparkSession, path, payloads=False), "records")
    own = captures(found)
    page_id = F.col("metadata.fields")["page-id"].cast("bigint")
    rows = own.select(page_id.alias("page_id"), "response.*", F.col("request.uri").alias("uri"))
    names = found.where(F.col("record_type") == "metadata").select(
        F.regexp_replace("concurrent_to", "^<urn:request:", "<urn:capture:").alias("refers_to"),
        F.col("fields")["page-id"].cast("bigint").alias("refers_to_page"),
    )
    return rows.join(names, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"), "uri",
        (F.col("payload_digest") == F.col("declared_digest")).alias("intact"),
    )

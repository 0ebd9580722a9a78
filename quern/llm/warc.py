"""Web archives: pages written as WARC records in segments, and read back by reassembly.

A page is an HTTP response in chunked transfer framing.  A response longer than ``SEGMENT`` bytes is cut: the first
piece stays a ``response`` record, the others are ``continuation`` records that name their origin and their number; the
last one holds the total length.  Of pages of one payload that of the greatest page_id is the response and the others
are ``revisit`` records that refer to it.

Spark's text writer makes the files (its line separator is the blank line pair that ends a record), so any store that
it knows will do; a file has at most ``RECORDS`` records of bounded size, and a reader holds one file and one page.
Reading groups continuations by origin, orders them by number, verifies numbers, total length and payload digest, and
decodes the framing; a record that fails is an error, never skipped.

Edge cases: a null html counts as empty; a null url has no target header, line ends in a url are percent-encoded;
rows of one page_id and payload share a record id and are all read back; pages of null page_id are responses if no
other page has their payload; an empty table makes archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

SEGMENT, CHUNK, RECORDS = 1 << 15, 1 << 13, 2048
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = [x.split(b":", 1) for x in head.split(b"\r\n")[1:]]
    fields = {x[0].strip().lower(): x[1].strip().lower() for x in lines if len(x) == 2}
    return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


# ---- records


def record_id(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha}')}>"


def record(fields: dict, block: bytes) -> bytes:
    """A record without the two blank lines that end it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(page_id: int | None, url: str | None, payload: bytes, owner: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of a page; ``owner`` is the page that has its payload, if that is another one."""
    sha = digest(payload)
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    shared = {"WARC-Target-URI": target, "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{sha}", "X-Page-ID": page_id}
    if owner is not None:
        head = {"WARC-Type": "revisit", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Refers-To": record_id(owner, sha)}
        profile = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [record(head | profile | shared, _HTTP)]
    name = record_id(page_id, sha)
    block = _HTTP + chunked(payload)
    head = {"WARC-Type": "response", "WARC-Record-ID": name} | shared
    if len(block) <= segment:
        return [record(head, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record(head | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = {"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}
        own = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{n}')}>", "WARC-Segment-Origin-ID": name}
        out.append(record({"WARC-Type": "continuation", **own, "WARC-Segment-Number": n} | total | shared, part))
    return out


def parsed(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (names in lower case) and block of each record of an archive, plain or compressed."""
    raw = io.BytesIO(data)
    file = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = file.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield fields, block


def reassembled(parts: list[tuple[int, bytes]], total: int | None, sha: str) -> bytes:
    """The payload of a segmented response from its numbered pieces."""
    if [n for n, _ in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments are missing")
    block = b"".join(p for _, p in parts)
    if len(block) != total:
        raise ValueError(f"segments have {len(block)} bytes instead of {total}")
    return _verified(payload_of(block), sha)


def _verified(payload: bytes, sha: str) -> bytes:
    if digest(payload) != sha:
        raise ValueError("a payload is not that of its digest")
    return payload


# ---- archives


def write(pages: DataFrame, at: str, least_revisit: int = 0, segment: int = SEGMENT) -> None:
    """Writes pages (page_id, url, html) below the folder ``at``; payloads below ``least_revisit`` bytes are never revisits."""
    d = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    d = d.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    owners = d.where(F.octet_length("html") >= least_revisit).groupBy("sha").agg(
        F.max("page_id").alias("owner"), F.count("*").alias("n")
    )
    # owners are one row each; a payload of very many pages is split by the join itself (adaptive skew handling)
    d = d.join(owners.where("n > 1").drop("n"), "sha", "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    d = d.select("page_id", "url", "html", other.alias("owner"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out: list[bytes] = []
                for r in batch.slice(i, 64).to_pylist():
                    out += page_records(r["page_id"], r["url"], r["html"].encode(), r["owner"], segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    d = d.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
    d.write.option("maxRecordsPerFile", RECORDS).text(at, compression="gzip", lineSep="\r\n\r\n")


_READ = pa.schema(
    [
        ("id", pa.string()),
        ("refers", pa.string()),
        ("page_id", pa.int64()),
        ("digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("number", pa.int32()),
        ("total", pa.int64()),
        ("part", pa.binary()),
    ]
)
_READ_SQL = "id string, refers string, page_id long, digest string, payload_bytes long, number int, total long, part binary"


def _row(fields: dict, block: bytes) -> dict:
    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    row = {
        "id": fields.get("warc-segment-origin-id", fields["warc-record-id"]),
        "refers": fields.get("warc-refers-to"),
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
        "digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "payload_bytes": None,
        "number": int(number) if number else None,
        "total": int(total) if total else None,
        "part": block if number else None,
    }
    if not number and fields["warc-type"] == "response":
        row["payload_bytes"] = len(_verified(payload_of(block), row["digest"]))
    return row


def read(spark: SparkSession, at: str) -> DataFrame:
    """For each page of the archives page_id, payload_bytes, payload_digest, record_type and refers_to."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                for fields, block in parsed(data.as_py()):
                    if fields["warc-type"] in ("response", "continuation", "revisit"):
                        rows.append(_row(fields, block))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one page at a time
                r = batch.slice(i, 1).to_pylist()[0]
                parts = [(p["number"], p["part"]) for p in r["parts"]]
                n = len(reassembled(parts, r["total"], r["digest"]))
                row = {"id": r["id"], "page_id": r["page_id"], "digest": r["digest"], "payload_bytes": n, "copies": r["copies"]}
                yield pa.RecordBatch.from_pylist([row], schema=_WHOLE)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(at).select("content")
    rows = common.written(files.mapInArrow(parse, _READ_SQL), "warc-records")
    # rows of one page_id and payload have the same segments: they are reassembled once and counted
    parts = rows.where("number IS NOT NULL").groupBy("id", "number").agg(
        F.count("*").alias("copies"), F.first("part").alias("part"), F.max("total").alias("total"),
        F.first("page_id").alias("page_id"), F.first("digest").alias("digest"),
    )
    groups = parts.groupBy("id").agg(
        F.first("page_id").alias("page_id"), F.first("digest").alias("digest"), F.max("total").alias("total"),
        F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("number", "part"))).alias("parts"),
    )
    whole = groups.mapInArrow(assemble, "id string, page_id long, digest string, payload_bytes long, copies long")
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
    narrow = ["id", "page_id", "digest", "payload_bytes"]
    responses = rows.where("number IS NULL AND refers IS NULL").select(*narrow).union(whole.select(*narrow))
    named = responses.groupBy("id", "digest").agg(
        F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes")
    )
    revisits = rows.where("refers IS NOT NULL").select("page_id", "digest", F.col("refers").alias("id"))
    revisits = revisits.join(named, ["id", "digest"], "left")
    out = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest")]
    first = responses.select(*out, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return first.union(revisits.select(*out, F.lit("revisit").alias("record_type"), "refers_to"))


_WHOLE = pa.schema(
    [("id", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("copies", pa.int64())]
)

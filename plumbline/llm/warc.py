"""WARC writing and reading: revisits, segmented records, chunked transfer framing.

``write_archives`` turns page rows into WARC/1.1 records: payloads that occur more than once become one response
(the row with the largest page_id) and revisits that refer to it; blocks above ``SEGMENT_BYTES`` are cut into a
first segment and continuation records; response bodies use chunked transfer framing. Spark's own text writer, with
the two line ends of a record as its separator, writes the files (gzip), so any shared store will do.

``read_archives`` parses whole files by Content-Length, ``reassemble`` groups the segments of a record by origin
identifier, orders them by segment number, verifies numbers and total length, and decodes the chunked framing.
Records that are whole go around the shuffle.

Defined results: a null payload is empty, a null url an empty target; page_id may be null; repeated rows give a
record each (rows that repeat the largest page_id of their payload are all responses); an empty table gives no
record; further columns are ignored. A record with a gap, a missing end or a wrong length is reported with
``complete = false`` and no payload. Memory is bounded by one archive (``ARCHIVE_BYTES`` of payload, or one
larger page) and one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from plumbline.llm.common import shared_dir, table, written

VERSION, EOL, RECORD_END = b"WARC/1.1", b"\r\n", "\r\n\r\n"
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 8 << 10
ARCHIVE_BYTES = 32 << 20
#: Groups of equal payloads (48 bytes each) that are broadcast at most.
BROADCAST_GROUPS = 250_000
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, None if the framing is broken or ends early."""
    out, at = [], 0
    while True:
        end = body.find(EOL, at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return None
        at = end + 2
        if not n:
            return b"".join(out)
        if n < 0 or body[at + n : at + n + 2] != EOL:
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + EOL + head.encode() + EOL + block


def page_records(row_id: str, page_id: str, url: str, payload: bytes, refers_to: str | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, each without the two line ends that close it."""
    rid = f"<urn:plumbline:{page_id}:{digest(payload)}{row_id}>"
    fields = [("WARC-Record-ID", rid), ("WARC-Date", _DATE), ("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~")), ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("X-Page-ID", page_id), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        refer = [("WARC-Refers-To", f"<urn:plumbline:{refers_to}:{digest(payload)}>"), ("WARC-Profile", _PROFILE)]
        yield _record([("WARC-Type", "revisit"), *fields, *refer], http)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *fields], block)
        return
    yield _record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", "1")], block[:segment])
    for n, at in enumerate(range(segment, len(block), segment), 2):
        own = [("WARC-Record-ID", f"{rid[:-1]}/{n}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(n))]
        if at + segment >= len(block):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record([("WARC-Type", "continuation"), *own], block[at : at + segment])


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of an uncompressed archive, by Content-Length."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = {}
        for line in data[at:end].split(EOL)[1:]:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields.get("content-length") or 0)
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def _payload(block: bytes) -> tuple[bytes | None, int | None]:
    """Payload of an HTTP block and the length its header states."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip().lower()) for k, _, v in (x.partition(b":") for x in head.split(EOL)[1:]))
    stated = int(fields[b"content-length"]) if fields.get(b"content-length", b"").isdigit() else None
    return (unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body), stated


def with_responses(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: the response's page_id for rows that become revisits.

    Payloads are told apart by length and SHA-256, which alone are shuffled and counted. Only groups of at least two rows go
    back to the pages: up to ``BROADCAST_GROUPS`` of them to every executor, more by a join that shuffles the pages.
    """
    keyed = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = keyed.withColumns({"size": F.octet_length("payload"), "key": F.unhex(F.sha2("payload", 256))})
    groups = keyed.groupBy("size", "key").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes))
    groups = written(groups.select("size", "key", "keeper"), "payload-groups")
    few = F.broadcast(groups) if isinstance(pages.schema["page_id"].dataType, NumericType) and groups.count() <= BROADCAST_GROUPS else groups
    return keyed.join(few, ["size", "key"], "left").select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("keeper"), F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[bytes] = []
            for page_id, url, payload, refers, row, keeper in zip(b["page_id"], b["url"], b["payload"], b["refers_to"], b["row"], b["is_keeper"], strict=True):
                own = "" if keeper else f":{row}"  # a response that others may refer to has an identifier without row number
                out += page_records(own, page_id, url or "", bytes(payload), refers if isinstance(refers, str) else None, segment_bytes)
                if sum(map(len, out[-8:])) > 1 << 20 or len(out) > 2000:
                    yield pd.DataFrame({"record": out})
                    out = []
            if out:
                yield pd.DataFrame({"record": out})

    rows = with_responses(pages, min_revisit_bytes).select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page_id"),
        "url",
        "payload",
        F.col("refers_to").cast("string").alias("refers_to"),
        F.monotonically_increasing_id().alias("row"),
        (F.col("refers_to").isNull() & F.col("page_id").isNotNull()).alias("is_keeper"),
    )
    per_file = max(1, archive_bytes // (segment_bytes + 1024))
    (
        rows.mapInPandas(records, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", str(per_file))
        .text(path)
    )


_RECORD = "record_id string, origin_id string, segment int, total long, type string, page_id string, uri string, refers_to string, stated_digest string, block binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record of the archives (plain or gzip) below ``path``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                data = bytes(data)
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                for f, block in parse_records(data):
                    number = int(f["warc-segment-number"]) if f.get("warc-segment-number", "").isdigit() else None
                    total = int(f["warc-segment-total-length"]) if f.get("warc-segment-total-length", "").isdigit() else None
                    rows.append((f.get("warc-record-id"), f.get("warc-segment-origin-id"), number, total, f.get("warc-type"), f.get("x-page-id"), unquote(f.get("warc-target-uri", "")), f.get("warc-refers-to"), f.get("warc-payload-digest"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=names).astype({"segment": "Int32", "total": "Int64"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"segment": "Int32", "total": "Int64"})

    names = [x.split()[0] for x in _RECORD.split(", ")]
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, _RECORD)


_WHOLE = "record_id string, type string, page_id string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, complete boolean"


def reassemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Whole records: segments joined and verified, HTTP framing removed, digests of the full payload."""

    def whole(rid, kind, page, uri, refers, stated, block, good):
        payload, size = _payload(block) if good else (None, None)
        if kind == "revisit":
            return rid, kind, page, uri, refers, None, size, (stated or "")[5:], good
        if payload is None:
            return rid, kind, page, uri, refers, None, None, None, False
        own = digest(payload)
        return rid, kind, page, uri, refers, payload if with_payload else None, len(payload), own, stated is None or stated[5:] == own

    names = [x.split()[0] for x in _WHOLE.split(", ")]

    def frame(rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    def singles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield frame([whole(*x) for x in zip(b["record_id"], b["type"], b["page_id"], b["uri"], b["refers_to"], b["stated_digest"], map(bytes, b["block"]), [True] * len(b), strict=True)])

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for head, copies, parts in zip(b["head"], b["copies"], b["parts"], strict=True):
                parts = sorted(parts, key=lambda p: p["segment"])
                numbers = [p["segment"] for p in parts]
                block = b"".join(bytes(p["block"]) for p in parts)
                good = head is not None and numbers == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
                h = head or dict.fromkeys(("record_id", "type", "page_id", "uri", "refers_to", "stated_digest"))
                rows += [whole(h["record_id"], h["type"], h["page_id"], h["uri"], h["refers_to"], h["stated_digest"], block, good)] * max(1, int(copies))
            yield frame(rows)

    segments = records.where("segment IS NOT NULL")
    # Equal copies of a segment (a page row that was there twice) meet here, before the blocks are gathered.
    once = segments.groupBy(F.coalesce("origin_id", "record_id").alias("origin"), "segment").agg(
        F.count("*").alias("copies"),
        F.first(F.struct("total", "block")).alias("part"),
        F.first(F.when(F.col("origin_id").isNull(), F.struct("record_id", "type", "page_id", "uri", "refers_to", "stated_digest"))).alias("head"),
    )
    joined = once.groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.col("copies")).otherwise(0)).alias("copies"),
        F.first("head", ignorenulls=True).alias("head"),
        F.collect_list(F.struct("segment", F.col("part.total").alias("total"), F.col("part.block").alias("block"))).alias("parts"),
    )
    return records.where("segment IS NULL").mapInPandas(singles, _WHOLE).unionByName(joined.mapInPandas(groups, _WHOLE))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    page = F.when(F.col("page_id") != "null", F.col("page_id").cast("long"))
    return reassemble(read_archives(spark, path), with_payload=False).select(
        page.alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.regexp_extract("refers_to", r"^<urn:plumbline:(-?\d+):", 1).try_cast("long").alias("refers_to"),
    )


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keeper FROM p),
b AS (
  SELECT page_id, string_agg(substr('{_B32}', CAST((CAST('0x' || substr(x, CAST(10 * g + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * k AS INTEGER)) & 31 AS INTEGER) + 1, 1), '' ORDER BY g, k) AS payload_digest
  FROM d, range(4) AS r(g), range(8) AS s(k) GROUP BY page_id
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper > page_id THEN keeper END AS refers_to
FROM d JOIN b USING (page_id)
"""

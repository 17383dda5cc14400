"""Operator 9, WARC: writer, monolithic gzip normaliser with a sidecar index, reader.

The writer puts records into archives of a few MB, each one gzip stream as a whole.
The normaliser inflates such a stream once, from front to end, cuts it into records
by their Content-Length, writes every record as a gzip member of its own and keeps
an index (offset, length, record id, type), so that one record can be read without
the others.  It takes archives that are members already, too.  The reader goes by
the index.

Archives are rows (archive, content) of a table in the shared folder: every executor
can read and write them, and a lost task is simply run again.

Of records with equal payloads of at least ``LEAST`` bytes, those of the largest
page_id are responses and the others revisits of it, without a payload.

Records carry the format's mandatory headers.  Their ids are made of the page_id and
the row's number, so rows that share a page_id differ; their date is a parameter, so a
rerun writes the same bytes.  The normaliser and the reader take archives of others too:
versions 1.0 and 1.1, header names in any case, any space around values, folded values,
digests in base 32.  What isn't one of our pages has a null page_id, and a record
without a payload digest or length gets those of its block.

Null html is an empty payload; null urls are empty.  A row with a null page_id is
always a response.  Rows that repeat the winning page_id are responses each; revisits
refer to the last of them.  Control characters and spaces in urls are percent-encoded.
Payloads of any length are written whole.  A stream that ends within a record raises an
error.  An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import common

LEAST = 1000
ARCHIVE_BYTES = 8 << 20         # payload after which an archive is closed
CHUNK = 1 << 20
ROWS = 1 << 63                  # above every row number
#: The format's marks and header names.
VERSION = b"WARC/1.1\r\n"
VERSIONS = ("WARC/1.0", "WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BREAK = b"\r\n\r\n"
ARCHIVE_SCHEMA = "archive string, content binary"
NORMAL_SCHEMA = "archive string, content binary, index array<struct<offset: long, length: long, record_id: string, record_type: string>>"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def _urn(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def record(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, int] | None, date: str = DATE) -> bytes:
    """``refers_to``: page_id and row of the response that a revisit repeats."""
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, row)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(*refers_to)}", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return VERSION + "\r\n".join(head).encode() + BREAK + payload + BREAK


def headers(head: bytes) -> dict[str, str]:
    """Values by header name in lower case."""
    version, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    if version.strip().upper() not in VERSIONS:
        raise ValueError("not a WARC record")
    pairs = (x.partition(":") for x in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _archives(date: str):
    """One gzip stream over the records of each few MB of payload."""
    def rows(batches):
        name, gz, parts, held = "", None, [], 0
        for batch in batches:
            for page_id, url, html, digest, winner, winner_row, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gz is None:
                    name, gz, parts, held = f"pages-{row}", zlib.compressobj(6, zlib.DEFLATED, 31), [], 0
                payload = (html or "").encode()
                refers_to = None if winner is None else (winner, winner_row)
                parts.append(gz.compress(record(page_id, row, url, payload, digest, refers_to, date)))
                held += len(payload)
                if held >= ARCHIVE_BYTES:
                    yield _archive(name, parts, gz)
                    gz = None
        if gz is not None:
            yield _archive(name, parts, gz)
    return rows


def _archive(name, parts, gz):
    return pa.record_batch({"archive": [name], "content": pa.array([b"".join(parts) + gz.flush()], pa.binary())})


def inflated(content: bytes):
    """The bytes of one or several gzip members, in chunks."""
    rest = memoryview(content)
    while len(rest):
        gz = zlib.decompressobj(31)
        at = 0
        while not gz.eof:
            data = gz.unconsumed_tail
            if not data:
                data = rest[at: at + CHUNK]
                at += len(data)
            out = gz.decompress(data, CHUNK)
            if not out and not len(data):
                raise ValueError("the gzip stream ends early")
            yield out
        rest = rest[at - len(gz.unused_data):]


def records(content: bytes):
    """(headers, whole record) of an archive, inflated once."""
    held = bytearray()
    head: dict[str, str] | None = None
    end = 0
    for chunk in inflated(content):
        held += chunk
        while True:
            if head is None:
                at = held.find(BREAK)
                if at < 0:
                    break
                head = headers(bytes(held[:at]))
                end = at + len(BREAK) + int(head["content-length"]) + len(BREAK)
            if len(held) < end:
                break
            yield head, bytes(held[:end])
            del held[:end]
            head = None
    if held:
        raise ValueError("the archive ends within a record")


def normalise(content: bytes) -> tuple[bytes, list[dict]]:
    """The archive with one gzip member per record, and its index."""
    out, index = bytearray(), []
    for head, whole in records(content):
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = gz.compress(whole) + gz.flush()
        index.append({"offset": len(out), "length": len(member), "record_id": head["warc-record-id"], "record_type": head["warc-type"]})
        out += member
    return bytes(out), index


def _normal_rows(batches):
    index_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]))
    for batch in batches:
        for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
            out, index = normalise(content.as_py())
            yield pa.record_batch({"archive": [name], "content": pa.array([out], pa.binary()), "index": pa.array([index], index_type)})


def _page(urn: str) -> int | None:
    ours = re.fullmatch(r"<urn:page:(-?\d+):\d+>", urn)
    return int(ours[1]) if ours else None


def _hex_digest(value: str) -> str:
    """The SHA-1 of a digest header as lower-case hex; its value may be hex or base 32."""
    name, _, digest = value.partition(":")
    if name.strip().lower() != "sha1":
        return value
    return digest.strip().lower() if len(digest.strip()) == 40 else base64.b32decode(digest.strip().upper()).hex()


def read_member(member: bytes) -> dict:
    whole = zlib.decompress(member, 31)
    at = whole.find(BREAK)
    head = headers(whole[:at])
    payload = whole[at + len(BREAK): -len(BREAK)]
    own = hashlib.sha1(payload).hexdigest()
    digest = _hex_digest(head["warc-payload-digest"]) if "warc-payload-digest" in head else own
    ours = _page(head["warc-record-id"]) is not None or head["warc-record-id"].startswith("<urn:page::")
    # A foreign response's block has the HTTP headers before its payload, so only ours can be compared as a whole.
    if ours and head["warc-type"] == "response" and own != digest:
        raise ValueError(f"{head['warc-record-id']}: the payload doesn't match its digest")
    return {"page_id": _page(head["warc-record-id"]), "payload_bytes": int(head.get("warc-payload-length", len(payload))), "payload_digest": digest,
            "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to", "")),
            "url": head.get("warc-target-uri", ""), "payload": payload}


def _read_rows(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for content, index in zip(batch.column("content"), batch.column("index"), strict=True):
            content = content.as_py()
            found = [read_member(content[x["offset"]: x["offset"] + x["length"]]) for x in index.as_py()]
            yield pa.RecordBatch.from_pylist(found, schema=schema)


def write_archives(spark: SparkSession, pages: DataFrame, date: str = DATE) -> DataFrame:
    """(archive, content): monolithic gzip archives of (page_id, url, html) rows."""
    marked = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
                          F.monotonically_increasing_id().alias("row"))
    long = (F.octet_length("html") >= LEAST) & F.col("page_id").isNotNull()
    # Page and row in one number, page first: its maximum is kept by a hash aggregate, a struct's would be by a sort.
    both = F.expr(f"CAST(page_id AS DECIMAL(19, 0)) * {ROWS} + row")
    winners = (marked.where(long).groupBy("digest").agg(F.max(both).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
               .selectExpr("digest", f"CAST(pmod(top, {ROWS}) AS LONG) AS top_row", f"(top - pmod(top, {ROWS})) div {ROWS} AS top_page"))
    # A short payload has no winner: its digest is that of a text below the bound.
    repeats = F.col("page_id") != F.col("top_page")
    rows = marked.join(winners, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(repeats, F.col("top_page")).alias("winner"),
        F.when(repeats, F.col("top_row")).alias("winner_row"), "row")
    return common.stage_table(spark, rows.mapInArrow(_archives(date), ARCHIVE_SCHEMA), "op9-archives")


def normalise_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """(archive, content, index): one gzip member per record, with offsets."""
    return common.stage_table(spark, archives.select("archive", "content").mapInArrow(_normal_rows, NORMAL_SCHEMA), "op9-members")


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of normalised archives, by their index."""
    return archives.select("content", "index").mapInArrow(_read_rows, RECORD_SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(common.table(sf_dir, "pages"))
    members = normalise_archives(spark, write_archives(spark, pages))
    return read_archives(members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS top FROM p WHERE b >= 1000 GROUP BY d)
SELECT page_id, b::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.top <> page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
QUERIES = {"op9_warc": op9_warc}
SQL = {"op9_warc": OP9_SQL}

"""WARC files: writing captures, and assembling their transactions when reading back.

A capture is a request, a response (or a revisit, where another capture has the same payload) and a metadata
record. Response and metadata name the request in WARC-Concurrent-To; reading joins the three kinds through
that identifier to one nested row per capture. Files are plain WARC 1.1, gzip-compressed, of bounded size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from io import BytesIO
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, table

#: Bytes of records from which a piece goes to its volume, and pieces in a volume; one record may be longer.
PIECE, PIECES = 1 << 20, 64
#: Payload bytes from which a capture may be a revisit; copies over which a hot payload's join is spread.
REVISIT_FROM, SALTS = 0, 16
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(text: str) -> str:
    """A header value; what a header line can't hold is percent-encoded."""
    return "".join(c if " " < c < "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def record(kind: str, own_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it; these part the records of a volume."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{own_id}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + CRLF + block


def capture(page_id: int | None, url: str, payload: bytes, first: int | None, serial: str) -> Iterator[bytes]:
    """Request, response or revisit (of page ``first``), and metadata."""
    request, own, sha = f"urn:request:{serial}", f"urn:page:{'' if page_id is None else page_id}:{digest(payload)}", digest(payload)
    target, linked = ("WARC-Target-URI", one_line(url)), ("WARC-Concurrent-To", f"<{request}>")
    yield record("request", request, [target, ("Content-Type", "application/http;msgtype=request")], f"GET {one_line(url) or '/'} HTTP/1.1\r\n\r\n".encode())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + CRLF + CRLF
    headers = [target, linked, ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response")]
    if first is None or first == page_id:
        yield record("response", own, headers, http + payload)
    else:
        same = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first}:{sha}>")]
        yield record("revisit", own, headers + same, http)
    fields = f"pageId: {'' if page_id is None else page_id}\r\npayloadBytes: {len(payload)}\r\n"
    yield record("metadata", f"urn:metadata:{serial}", [target, linked, ("Content-Type", "application/warc-fields")], fields.encode())


def with_first(work: Work, pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, payload) with ``first``: the largest page_id of an equal payload that other rows have.

    Payloads are equal if SHA-1 and length are. Counting combines before the shuffle; only payloads of
    several rows are looked up, each under 16 salts, so that a payload of a third of the rows spreads.
    """
    key = [F.sha1(F.col("payload").cast("binary")).alias("_sha"), F.octet_length("payload").alias("_bytes")]
    copies = pages.select("page_id", *key).groupBy("_sha", "_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("_n"))
    copies = copies.filter((F.col("_n") > 1) & (F.col("_bytes") >= REVISIT_FROM)).drop("_n")
    copies = work.save(copies, "copies").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.select("*", *key).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["_sha", "_bytes", "_salt"], "left").drop("_sha", "_bytes", "_salt")


def write(work: Work, pages: DataFrame, path: str, piece: int = PIECE, pieces: int = PIECES) -> None:
    """Writes the captures of ``pages`` (page_id, url, payload) to WARC files below ``path``; null urls and payloads are empty.

    A task holds one piece at a time; a volume has ``pieces`` of them, so that files are few and their size is bounded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, serial, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for known, page_id, url, payload, linked, first in zip(b.known, b.page_id, b.url, b.payload, b.linked, b["first"], strict=True):
                serial += 1
                for r in capture(page_id if known else None, url, payload.encode(), first if linked else None, f"{task}-{serial}"):
                    held.append(r)
                    size += len(r)
                if size >= piece:
                    yield pd.DataFrame({"piece": [b"\r\n\r\n".join(held).decode()]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"piece": [b"\r\n\r\n".join(held).decode()]})

    ready = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("payload", F.lit("")).alias("payload"))
    ready = with_first(work, ready)
    # Nullable integers would arrive as doubles; flags say which are null.
    for name, flag in (("page_id", "known"), ("first", "linked")):
        ready = ready.withColumn(flag, F.col(name).isNotNull()).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    # The separator written after each piece closes its last record.
    ready.mapInPandas(run, "piece string").write.option("maxRecordsPerFile", pieces).option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a WARC file, by their Content-Length; raises where the file breaks off."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (CRLF, b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        yield headers, block


PARSED = "kind string, link string, record_id string, url string, digest string, refers_to string, payload binary, fields string"


def parse(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of the records of ``files`` (content); ``link`` is the request's identifier. A response's digest is verified."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in PARSED.split(",")]
        for b in batches:
            for data in b.content:
                rows = []
                for h, block in records(gzip.GzipFile(fileobj=BytesIO(data))):
                    kind, own = h["warc-type"], h["warc-record-id"].strip("<>")
                    sha = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and digest(payload) != sha:
                        raise ValueError(f"digest of {own}")
                    link = own if kind == "request" else h["warc-concurrent-to"].strip("<>")
                    rows.append((kind, link, own, h.get("warc-target-uri"), sha, h.get("warc-refers-to", "").strip("<>") or None, payload if payloads else None, block.decode() if kind == "metadata" else None))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    rows = files.select("content").mapInPandas(run, PARSED)
    return rows if payloads else rows.drop("payload")


def assemble(parsed: DataFrame) -> DataFrame:
    """One row per capture: structs ``request``, ``response`` (a revisit has no payload) and ``metadata``."""
    part = lambda name, *cols: parsed.filter(F.col("kind").isin(*KINDS[name])).select("link", F.struct(*cols).alias(name))
    number = lambda name: F.nullif(F.regexp_extract("fields", rf"(?m)^{name}: (-?[0-9]*)\r?$", 1), F.lit("")).cast("long")
    request = part("request", "record_id", "url")
    response = part("response", F.col("kind").alias("type"), "record_id", "digest", "refers_to", *[c for c in parsed.columns if c == "payload"])
    metadata = part("metadata", "record_id", number("pageId").alias("page_id"), number("payloadBytes").alias("payload_bytes"))
    return request.join(response, "link", "left").join(metadata, "link", "left").drop("link")


KINDS = {"request": ("request",), "response": ("response", "revisit"), "metadata": ("metadata",)}


def read(work: Work, path: str, payloads: bool = True) -> DataFrame:
    """Captures of the WARC files below ``path``, assembled; the records are parsed once and saved.

    Without ``payloads``, these are read and their digests verified, but the responses don't carry them on.
    """
    files = work.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return assemble(work.save(parse(files, payloads), "records"))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC and read back. Rows that repeat the largest page_id of a payload are all responses."""
    work = Work(spark)
    pages, path = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload")), work.path("warc")
    write(work, pages, path)
    got = read(work, path, payloads=False)
    return got.select(
        F.col("metadata.page_id").alias("page_id"), F.col("metadata.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.nullif(F.regexp_extract("response.refers_to", r"^urn:page:(-?[0-9]+):", 1), F.lit("")).cast("long").alias("refers_to"),
    )


SQL_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT *, list_reduce(list_transform(string_split(upper(sha1(html)), ''), lambda c: lpad(bin(strpos('0123456789ABCDEF', c) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM b)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(0, 160, 5), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, k + j + 1, 1) = '1' THEN CAST(pow(2, 4 - j) AS INTEGER) ELSE 0 END))::INTEGER, 1)), lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""

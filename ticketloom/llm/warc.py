"""WARC archives of captures: written, read back and assembled to one row per capture.

Writing: every page becomes a transaction of three records - request, response (or
revisit) and metadata - tied together by WARC-Concurrent-To. Of pages with equal payload
the one of largest page_id is the response; the others revisit it. The archives are
``.warc`` text files, gzipped whole, of bounded size: the writer's line separator is the
pair of line ends that closes a WARC record.

Reading: each file is parsed by the lengths in its records, so line ends inside a payload
do no harm; record order and file do not matter. Requests, responses and metadata are
joined by record identifiers, and revisits by the record they refer to.

Null html is an empty payload; a null url gives no target URI. Line ends in a url are
percent-encoded. A null page_id is written without an identifier of the page and read
back as null. Equal rows give equal record identifiers; each keeps its own row. Of tied
payloads the largest page_id counts. A very long html is one record. Only page_id, url and
html are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.llm.common import scratch_path, small_side, written

#: Fixed values of the format.
END = "\r\n\r\n"
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 16 << 20


def _base32(hex40: Column) -> Column:
    """Base32 of a SHA-1 given as 40 hex digits: each 5 hex digits are 4 letters."""
    letters = []
    for i in range(8):
        n = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), 1 + F.shiftright(n, s).bitwiseAND(31), F.lit(1))
                    for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record_id(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), key))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing line ends; a null header is left out."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines,
                                F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))),
                    F.lit(END), block)


def records(pages: DataFrame) -> DataFrame:
    """One row per record: value, the record's text."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(
        F.col("page_id").cast("string").alias("page_id"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"))
    groups = pages.select(F.col("page_id"), F.sha1(html.cast("binary")).alias("digest")).groupBy("digest").agg(
        F.max("page_id").cast("string").alias("chief"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    spark = pages.sparkSession
    groups = small_side(written(groups, scratch_path(spark, "equal-payloads")))
    b = base.join(groups, "digest", "left")
    key = F.coalesce("page_id", F.lit("null"))
    chief = F.coalesce("chief", key)
    revisit = chief != key
    req, res, meta = (_record_id(k, key) for k in ("request", "response", "metadata"))
    sha = F.concat(F.lit("sha1:"), _base32(F.col("digest")))
    date = ("WARC-Date", F.lit(DATE))
    url = ("WARC-Target-URI", F.col("url"))
    host = F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]*", ""), F.lit("/"))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", req), date, url, ("WARC-Concurrent-To", res),
         ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("html").cast("string"), F.lit(END))
    response = _record(
        [("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", res),
         date, url, ("WARC-Payload-Digest", sha),
         ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
         ("WARC-Refers-To", F.when(revisit, _record_id("response", chief))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))))
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", meta), date, url, ("WARC-Concurrent-To", res),
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("via: corpus\r\n"), F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id")), F.lit(""))))
    return b.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the archives; rows are dealt over files of about ``file_bytes`` of payload."""
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    rows = records(pages.repartition(max(1, math.ceil(total / file_bytes)), "page_id", "url"))
    rows.write.option("lineSep", END).option("compression", "gzip").text(path)


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield head, data[start:stop]
        at = stop + 4


RECORD = ("type string, record_id string, concurrent_to string, refers_to string, uri string, date string, "
          "digest string, payload_bytes bigint, payload string, fields string")


def _records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows: dict[str, list] = {n: [] for n in names}
            for head, block in _parse(zlib.decompress(content.as_py(), 47)):
                kind = head["warc-type"]
                payload = digest = length = fields = None
                if kind in ("response", "revisit"):
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    length = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n"))
                                  if k.lower() == b"content-length")
                    if kind == "response":
                        found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if (found, len(body)) != (digest, length):
                            raise ValueError(f"damaged payload in {head['warc-record-id']}")
                        payload = body.decode("utf-8")
                elif kind == "metadata":
                    fields = block.decode("utf-8")
                row = (kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"),
                       head.get("warc-target-uri"), head.get("warc-date"), digest, length, payload, fields)
                for n, v in zip(names, row):
                    rows[n].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)


_SCHEMA = pa.schema([(x.split()[0], pa.int64() if x.endswith("bigint") else pa.string()) for x in RECORD.split(", ")])


def read_records(spark, path: str) -> DataFrame:
    """All records of the archives below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_records_of, RECORD)


def captures(recs: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, request, response, metadata, refers_to."""
    part = lambda kind: recs.where(F.col("type") == kind)
    page = F.expr("nullif(regexp_extract(fields, 'pageId: (-?[0-9]+)', 1), '')").cast("bigint")
    res = recs.where(F.col("type").isin("response", "revisit")).select(
        "record_id", F.struct("type", "record_id", "uri", "date", "digest", "payload_bytes", "payload",
                              "refers_to").alias("response"))
    # equal rows of pages give equal identifiers: their copies are counted, not multiplied
    req = part("request").groupBy("concurrent_to").agg(
        F.min(F.struct("record_id", "uri", "date")).alias("request"))
    meta = part("metadata").groupBy("concurrent_to").agg(
        F.min(F.struct("record_id", "fields", page.alias("page_id"))).alias("metadata"))
    tied = res.join(req, res["record_id"] == req["concurrent_to"], "left").drop("concurrent_to").join(
        meta, res["record_id"] == meta["concurrent_to"], "left").drop("concurrent_to")
    chiefs = meta.select(F.col("concurrent_to").alias("chief"), F.col("metadata.page_id").alias("refers_to"))
    # a response stands for itself, so that no null key gathers all responses in one task
    return tied.join(chiefs, F.coalesce("response.refers_to", "response.record_id") == F.col("chief"), "left").select(
        "metadata.page_id", "request", "response", "metadata",
        F.when(F.col("response.refers_to").isNotNull(), F.col("refers_to")).alias("refers_to"))


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back, and describe each capture."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    return captures(read_records(spark, path)).select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), "refers_to",
        F.col("request.record_id").isNotNull().alias("has_request"))

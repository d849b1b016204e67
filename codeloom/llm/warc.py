"""WARC archives: captures are written as request, response or revisit, and metadata records, and are assembled again.

Records are built as column expressions and written by Spark's text writer with the record separator of the format, so
every task writes its own gzipped archives to the shared folder. Archives are read as whole files of a bounded size and
cut by their content lengths. Assembly joins requests and metadata to their capture through WARC-Concurrent-To, and
revisits to what they refer to, and gives one nested row per capture.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

LEAST_REVISIT = 1000  # bytes of a payload that may be revisited
FILE_BYTES = 16_000_000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
RECORDS = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, "
    "content_type string, http_header string, payload binary"
)


def _record(kind: str, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing separator; the content length counts bytes."""
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}")]
    for name, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-") if a > 1 else F.lit("")), F.substring(h, a, n))))


def write(pages: DataFrame, path: str) -> None:
    """Archive ``pages`` (page_id, url, html). Of equal payloads of at least ``LEAST_REVISIT`` bytes the one with the
    largest page_id is the response and the others revisit it. A null html is an empty payload, a null url is left out."""
    one_line = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ")
    rows = pages.select("page_id", F.when(F.col("url").isNotNull(), one_line).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    large = rows.where(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = cut(large.where("n > 1").select("digest", "first_id"))
    size = rows.agg(F.avg("n_bytes").alias("mean")).first()["mean"] or 0.0
    rows = rows.join(repeated, "digest", "left")
    is_revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    name = lambda kind, key: _urn(F.lit(kind), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("digest"))
    capture = name("capture", "page_id")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    uri, concurrent = ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", F.concat(F.lit("<"), capture, F.lit(">")))
    of_http = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", capture, [uri, ("WARC-Payload-Digest", digest), of_http], F.concat(http, F.col("html")))
    refers = ("WARC-Refers-To", F.concat(F.lit("<"), name("capture", "first_id"), F.lit(">")))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    revisit = _record("revisit", capture, [uri, refers, profile, ("WARC-Payload-Digest", digest), of_http], http)
    request = _record("request", name("request", "page_id"), [uri, concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}")))
    metadata = _record("metadata", name("metadata", "page_id"), [uri, concurrent, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)))
    records = rows.select(F.explode(F.array(request, F.when(is_revisit, revisit).otherwise(response), metadata)).alias("value"))
    most = max(3, int(FILE_BYTES / (size / 3 + 400)))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of ``RECORDS`` from the bytes of an archive, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split(CRLF)[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields.get("content-length", "0"))
        block = data[stop + 4 : stop + 4 + size]
        http = None
        if fields.get("content-type", "").startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
        plain = lambda key: fields[key].strip("<>") if key in fields else None  # noqa: E731, B023
        yield (fields.get("warc-type"), plain("warc-record-id"), plain("warc-concurrent-to"), plain("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-payload-digest"), fields.get("content-type"), http, block)
        at = stop + 4 + size


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in RECORDS.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            yield pd.DataFrame(list(parse(content)), columns=columns)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, in ``RECORDS``' columns; an archive's records stay in their task."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_parse_files, RECORDS)


def assemble(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per response or revisit: record_type, record_id, capture, request, metadata (array), original.

    ``capture`` and ``original`` (of a revisit, what it refers to) are structs of the columns ``keep``; a request or
    metadata record joins the capture that it names as concurrent. Of repeated requests the first by id is taken; captures
    without one have null, and no metadata is an empty array. Records of other types, or that name no capture of the
    archive, are left out. ``records`` is read several times, so pass a stored or cut table.
    """
    keep = keep or [c for c in records.columns if c not in ("record_type", "concurrent_to")]
    body = F.struct(*keep)
    captures = records.where(F.col("record_type").isin("response", "revisit")).select("record_type", "record_id", "refers_to", body.alias("capture"))
    beside = records.where(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    is_request = F.col("record_type") == "request"
    beside = beside.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.min(F.when(is_request, F.struct("record_id", "target_uri", "http_header"))).alias("request"),
        F.sort_array(F.collect_set(F.when(~is_request, F.struct("record_id", "content_type", F.col("payload").alias("payload"))))).alias("metadata"),
    )
    out = captures.join(beside, "record_id", "left")
    # one response may be revisited by very many: it is the plain side of a join on the reference
    revisits = cut(out.where("refers_to IS NOT NULL"))
    others = out.where("refers_to IS NULL").withColumn("original", F.lit(None).cast(captures.schema["capture"].dataType))
    first = cut(captures.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("capture").alias("original")))
    both = others.unionByName(revisits.join(first, "refers_to", "left"))
    return both.select("record_type", "record_id", "capture", "request", F.coalesce("metadata", F.array()).alias("metadata"), "original")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and assemble: page_id, payload_bytes,
    payload_digest (both of the full payload), record_type, refers_to (the page_id of the response, for revisits)."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    records = read(spark, path)
    full = F.col("record_type") == "response"
    slim = cut(records.select(
        "record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "http_header", "content_type",
        F.when(F.col("record_type") == "metadata", F.col("payload")).alias("payload"),
        F.when(full, F.octet_length("payload").cast("long")).alias("payload_bytes"), F.when(full, F.sha1("payload")).alias("payload_digest"),
    ))
    found = assemble(slim, ["record_id", "payload_bytes", "payload_digest"])
    named = F.regexp_extract(F.get("metadata", F.lit(0))["payload"].cast("string"), "page-id: (-?[0-9]+)", 1)
    found = cut(found.select("record_type", "capture", "original", F.nullif(named, F.lit("")).cast("long").alias("page_id")))
    # the response's page is named by its own metadata record
    owners = cut(found.where("record_type = 'response'").groupBy(F.col("capture.record_id").alias("owner")).agg(F.max("page_id").alias("refers_to")))
    responses = found.where("original IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    revisits = found.where("original IS NOT NULL").withColumn("owner", F.col("original.record_id")).join(owners, "owner", "left").drop("owner")
    whole = F.coalesce("original", "capture")
    return responses.unionByName(revisits).select("page_id", whole["payload_bytes"].alias("payload_bytes"), whole["payload_digest"].alias("payload_digest"), "record_type", "refers_to")

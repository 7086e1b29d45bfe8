"""WARC archives with revisit records: write them through Spark's writers, read them, resolve revisits."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests kept as a broadcast table at most (about 100 bytes a row); beyond, the join shuffles.
FEW = 200_000


def headed(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``_id, _url, _payload, _digest`` (hex SHA-1 of the UTF-8 payload), ``_bytes``; null html is empty."""
    payload = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        F.col(id).cast("long").alias("_id"), F.col(url).alias("_url"), payload.alias("_payload"),
        F.sha1(payload.cast("binary")).alias("_digest"), F.octet_length(payload).cast("long").alias("_bytes"),
    )


def _record_id(id_: Column) -> Column:
    h = F.md5(F.concat(F.lit("record "), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null. Line ends in a value are percent-coded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z", per_file: int = 20_000) -> None:
    """Writes ``pages`` as gzipped WARC/1.1 files under ``path``, one record a row.

    Headers alone are shuffled, by payload digest: of records with equal payloads of at least
    ``least`` bytes that with the largest id is the response and the others are revisits, without
    payload, that refer to it. Smaller payloads are all responses. Rows that share the largest id
    are all responses; rows with a null id are responses. Payloads go straight from the scan to
    the archive; only if over ``FEW`` digests repeat does the join shuffle them.
    """
    rows = headed(pages, id, url, html)
    first = rows.filter(F.col("_bytes") >= least).groupBy("_digest").agg(F.max("_id").alias("_first"), F.count("*").alias("_n"))
    first = common.written(first.filter("_n > 1 and _first is not null").select(F.col("_digest").alias("_same"), "_first"), "warc-first")
    rows = rows.join(F.broadcast(first) if first.count() <= FEW else first, F.col("_digest") == F.col("_same"), "left")
    revisit = F.coalesce(F.col("_id") != F.col("_first"), F.lit(False)) & F.col("_id").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("_payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("_url")),
        _line("WARC-Page-ID", F.col("_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("_first")))),
        _line("WARC-Refers-To-Page-ID", F.when(revisit, F.col("_first").cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_bytes"))).cast("string")),
        F.lit(CRLF),
    )
    writer = rows.select(F.concat(head, body).alias("value")).write.option("compression", "gzip").option("lineSep", CRLF * 2)
    writer.option("maxRecordsPerFile", per_file).text(path)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive: WARC headers (names in lower case) and block. Holds one record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a WARC header ends early")
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("a WARC block ends early")
        yield head, block


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    for pdf in batches:
        for content in pdf["content"]:
            out, held = [], 0
            for head, block in records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                http, _, payload = block.partition(b"\r\n\r\n")
                full = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                kind = head["warc-type"]
                told = head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != told):
                    raise ValueError(f"record {head['warc-record-id']} is damaged")
                ids = [int(head[x]) if x in head else None for x in ("warc-page-id", "warc-refers-to-page-id")]
                out.append((ids[0], head.get("warc-target-uri"), kind, None if kind == "revisit" else payload.decode("utf-8"), full, told, ids[1]))
                held += len(payload)
                if held > 8 << 20:
                    yield _frame(out, names)
                    out, held = [], 0
            yield _frame(out, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    return pdf.astype({"id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records under ``path``: id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to.

    Every response's payload is checked against its length and digest; a damaged one raises.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(_parse, "id long, url string, record_type string, payload string, payload_bytes long, payload_digest string, refers_to long")


def resolved(archive: DataFrame) -> DataFrame:
    """``archive`` with each revisit's payload taken from the response it refers to (an equi-join on id)."""
    first = archive.filter("record_type = 'response' and id is not null").groupBy("id", "payload_digest").agg(F.first("payload").alias("_found"))
    first = first.select(F.col("id").alias("_rid"), F.col("payload_digest").alias("_rd"), "_found")
    out = archive.join(first, (archive["refers_to"] == first["_rid"]) & (archive["payload_digest"] == first["_rd"]), "left")
    return out.select(*[F.coalesce("payload", "_found").alias("payload") if c == "payload" else archive[c] for c in archive.columns])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""

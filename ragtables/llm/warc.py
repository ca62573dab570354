"""Content-addressed web archive: payloads stored once by digest, exact record headers apart, records rebuilt by a join."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtables.llm.common import broadcast_checked
from ragtables.session import materialize, scratch_path

LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def header_bytes(page_id: int | None, url: str | None, size: int, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """Exact bytes of a record before its payload: WARC header and HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    length = len(http) + (0 if revisit else size)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + _END + http


def parse_header(head: bytes) -> tuple[dict[str, str], int]:
    """Fields of the WARC header in lower case, and where the payload begins, after the HTTP header."""
    end = head.index(_END)
    version, *lines = head[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    return fields, head.index(_END, end + len(_END)) + len(_END)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "size", "sha1", "refers_to", "revisit")], strict=True)
        heads = [header_bytes(p, u, n, bytes.fromhex(s), r, v) for p, u, n, s, r, v in rows]
        yield pa.record_batch([batch.column("digest"), pa.array(heads, pa.binary())], names=["digest", "header"])


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) under ``path``: ``headers`` (digest, header), ``payloads`` (digest, payload).

    A payload is the UTF-8 text (null: empty), its key the SHA-256 with the length. Of equal payloads of at least
    ``least_bytes`` bytes the record with the smallest page_id is a response, the others are revisits of it; smaller ones
    are all responses. Payloads stay where they are read: only the records that do not store theirs are found by
    a join, which is broadcast if its measured size allows. Rows without page_id are revisits if the payload has a record
    with an id. Repeated rows are records each; their payload is stored once. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    digest = F.concat_ws(":", F.sha2("payload", 256), F.length("payload"))
    rows = rows.withColumn("digest", digest)
    records = materialize(rows.select("page_id", "url", "digest", F.length("payload").cast("long").alias("size"),
                                      F.sha1("payload").alias("sha1")), "records")
    copies = records.groupBy("digest", "page_id").agg(F.count("*").alias("copies"))
    first = copies.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("copies").alias("copies"))
    shared = materialize(first.filter("copies > 1").select("digest", "first"), "shared")

    joined = records.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    headers = joined.withColumn("revisit", F.coalesce(revisit, F.lit(False))).select(
        "digest", "page_id", "url", "size", "sha1", "revisit", F.when(F.col("revisit"), F.col("first")).alias("refers_to"))
    headers.mapInArrow(_headers, "digest string, header binary").write.parquet(f"{path}/headers")

    # What is in several records is stored from its first one; if that is repeated or nameless, from any of its rows.
    several = copies.join(shared, "digest").select("digest", "page_id", F.when(
        F.col("page_id").eqNullSafe(F.col("first")), F.when(F.col("copies") > 1, 2).otherwise(1)).otherwise(0).alias("stores"))
    several = several.withColumn("hash", F.xxhash64("digest", "page_id")).select("hash", "stores").filter("stores <> 1")
    several = broadcast_checked(several.groupBy("hash").agg(F.max("stores").alias("stores")), "stored", row_bytes=32)
    placed = rows.withColumn("hash", F.xxhash64("digest", "page_id")).join(several, "hash", "left")
    placed.filter("stores is null").select("digest", "payload").write.parquet(f"{path}/payloads")
    placed.filter("stores = 2").select("digest", "payload").dropDuplicates(["digest"]).write.mode("append").parquet(f"{path}/payloads")


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record binary, payload binary"


def _number(urn: str | None) -> int | None:
    return int(urn.rpartition(":")[2].rstrip(">")) if urn else None


def _parse(whole: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for head, payload in zip(batch.column("header"), batch.column("payload"), strict=True):
                head, payload = head.as_py(), payload.as_py()
                fields, begin = parse_header(head)
                if payload is None:
                    raise ValueError(f"no payload for {fields.get('warc-record-id')}")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                revisit = fields["warc-type"] == "revisit"
                block = len(head) - head.index(_END) - len(_END) + (0 if revisit else len(payload))
                if begin != len(head) or f"sha1:{digest}" != fields["warc-payload-digest"] or block != int(fields["content-length"]):
                    raise ValueError(f"damaged record {fields.get('warc-record-id')}")
                record = head + (b"" if revisit else payload) + _END if whole else None
                out.append((_number(fields.get("warc-record-id")), fields.get("warc-target-uri"), len(payload), digest,
                            fields["warc-type"], _number(fields.get("warc-refers-to")), record, payload if whole else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                  names=[c.split()[0] for c in _RECORD.split(", ")])

    return parse


def read_archive(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Records of an archive: every header joined with its payload, checked by length and digest, and parsed.

    With ``whole`` come the exact bytes of each ``record`` (a revisit has no payload in its own bytes) and its ``payload``.
    A missing or altered payload is an error. A payload that very many records share is one row on its side of the join;
    the headers' side is split by Spark at run time.
    """
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    joined = headers.join(payloads, "digest", "left").select("header", "payload")
    return joined.mapInArrow(_parse(whole), _RECORD)


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write an archive and read it back, without the bytes."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, least_bytes)
    return read_archive(pages.sparkSession, path, whole=False).drop("record", "payload")

"""WARC archives: written, read back, and assembled into one row per capture.

Archives are gzip files of WARC/1.1 records, written and read with Spark's text
source: the record separator is the line separator. A gzip file is read by one
task from its start, as a stream of bounded pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epistride.llm.keyed import numbered_copies, spread_lookup

#: Payloads below this length never become a revisit.
REVISIT_BYTES = 100
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BETWEEN = "\r\n\r\nWARC/1."


def record_id(kind: str, page: Column, copy: Column | None = None) -> Column:
    """A URN made from the kind of record and the page's id, and the number of the row among those that repeat the id."""
    told = [F.lit(f"{kind}:"), F.coalesce(page.cast("string"), F.lit(""))]
    told += [] if copy is None else [F.when(copy > 0, F.concat(F.lit(":"), copy.cast("string"))).otherwise("")]
    name = F.md5(F.concat(*told))
    parts = [F.substring(name, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the blank lines behind it; a null field is left out."""
    named = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields]
    head = F.concat_ws("\r\n", F.lit(VERSION), *named, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit("\r\n\r\n"), block)


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (id, url, payload) with payload_bytes, payload_digest and refers_to.

    refers_to is the least id with the same payload, null for that page itself
    and for payloads below ``least_bytes``.
    """
    sized = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    large = sized.filter(F.col("payload_bytes") >= least_bytes)
    firsts = large.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Only ids and digests move; a digest that many pages share is spread by page.
    slim = large.select("id", "payload_digest").distinct()
    again = spread_lookup(slim, firsts, ["payload_digest"], ["id"]).filter("id <> first")
    again = again.select(F.col("id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("first").alias("refers_to"))
    return sized.join(again, (sized.id == F.col("_id")) & (sized.payload_digest == F.col("_digest")), "left").drop("_id", "_digest")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z",
                  least_bytes: int = REVISIT_BYTES) -> None:
    """Write a request, a response or revisit, and a metadata record for every page.

    The page's id is kept in the field Page-Id. A null payload or url is
    empty. Ids name the records; rows that repeat an id are told apart by a
    number, and a null id is one that no record refers to.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    # A null id has a key of its own.
    rows = numbered_copies(rows.withColumn("name", F.coalesce(F.col("id").cast("string"), F.lit(""))), ["name"], "copy")
    rows = with_revisits(rows, least_bytes)
    revisit = F.col("refers_to").isNotNull()
    main_id = record_id("response", F.col("id"), F.col("copy"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date)), ("Page-Id", F.col("id"))]
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")
    )
    main = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", main_id),
            *common,
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
            ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
            ("WARC-Refers-To", F.when(revisit, record_id("response", F.col("refers_to")))),
            ("Refers-To-Page-Id", F.col("refers_to")),
        ],
        # A revisit keeps the HTTP head, which says how long the payload was, and no payload.
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", F.col("id"), F.col("copy"))), *common, ("WARC-Concurrent-To", main_id),
         ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", F.col("id"), F.col("copy"))), *common, ("WARC-Concurrent-To", main_id),
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("fetched: "), F.lit(date), F.lit("\r\n")),
    )
    records = rows.select(F.explode(F.array(request, main, metadata)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


RECORD = (
    "record_id string, record_type string, concurrent_to string, target string, date string, refers_to string, declared_digest string, "
    "page_id long, refers_to_page_id long, status string, headers map<string,string>, payload binary, payload_bytes long, declared_bytes long, payload_digest string"
)


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:  # a folded line
            out[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            key, value = line.split(b":", 1)
            name = key.strip().decode("utf-8", "replace").lower()
            out[name] = value.strip().decode("utf-8", "replace")
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text and text.strip().isdigit() else None


def _parsed(head: bytes, block: bytes) -> dict:
    fields = _fields(head)
    status, http, payload = None, {}, block
    if fields.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        line, _, rest = top.partition(b"\r\n")
        status, http = line.decode("utf-8", "replace"), _fields(rest)
    return {
        "record_id": fields.get("warc-record-id"),
        "record_type": fields.get("warc-type"),
        "concurrent_to": fields.get("warc-concurrent-to"),
        "target": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "refers_to": fields.get("warc-refers-to"),
        "declared_digest": fields.get("warc-payload-digest"),
        "page_id": _number(fields.get("page-id")),
        "refers_to_page_id": _number(fields.get("refers-to-page-id")),
        "status": status,
        "headers": list(http.items()),
        "payload": payload,
        "payload_bytes": len(payload),
        "declared_bytes": _number(http.get("content-length")),
        "payload_digest": hashlib.sha256(payload).hexdigest(),
    }


_SCHEMA = pa.schema(
    [(c, pa.string()) for c in ("record_id", "record_type", "concurrent_to", "target", "date", "refers_to", "declared_digest")]
    + [("page_id", pa.int64()), ("refers_to_page_id", pa.int64()), ("status", pa.string()), ("headers", pa.map_(pa.string(), pa.string()))]
    + [("payload", pa.binary()), ("payload_bytes", pa.int64()), ("declared_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from pieces of files, in order.

    A piece that ends before its record does holds the separator in its
    payload and is joined with the next. A piece may also hold several
    records: the line reader misses a separator now and then where its buffer
    ends inside one. So only Content-Length says where a record ends.
    """
    mark = _BETWEEN.encode()
    path, head, block, wanted, open_record = None, b"", bytearray(), 0, False
    out: list[dict] = []
    size = 0

    for batch in batches:
        for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist()):
            if file != path:
                path, open_record = file, False
            if open_record:
                block += mark
                block += piece
                piece = b""
            while True:
                if not open_record:
                    head, found, rest = piece.partition(b"\r\n\r\n")
                    if not found:
                        break
                    block, wanted = bytearray(rest), _number(_fields(head).get("content-length")) or 0
                open_record = len(block) < wanted
                if open_record:
                    break
                out.append(_parsed(head, bytes(block[:wanted])))
                size += wanted
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                    out, size = [], 0
                if not block.startswith(mark, wanted):
                    break
                piece = bytes(block[wanted + len(mark) :])
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip archives below ``path``.

    Record ends follow Content-Length, so a payload may hold anything. A
    truncated last record is left out. payload is what follows the HTTP head
    for HTTP records and the whole block otherwise.
    """
    pieces = spark.read.option("lineSep", _BETWEEN).option("pathGlobFilter", "*.gz").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_records, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row per response or revisit, with its request and metadata records nested.

    Requests and metadata name their capture in concurrent_to. Where several
    requests do, the one of least record id stands; metadata come as an array
    ordered by record id; what a capture lacks is null or empty. Records
    that name no known capture give no row.
    """
    main = records.filter("record_type in ('response', 'revisit')")
    request = records.filter("record_type = 'request'").groupBy("concurrent_to").agg(
        F.min(F.struct("record_id", "target", "date", "status")).alias("request")
    )
    metadata = records.filter("record_type = 'metadata'").select("concurrent_to", F.struct("record_id", "date", "payload").alias("m"))
    metadata = metadata.groupBy("concurrent_to").agg(F.array_sort(F.collect_list("m")).alias("metadata"))
    joined = main.drop("concurrent_to").join(request.withColumnRenamed("concurrent_to", "_request_of"), F.col("record_id") == F.col("_request_of"), "left")
    joined = joined.join(metadata.withColumnRenamed("concurrent_to", "_metadata_of"), F.col("record_id") == F.col("_metadata_of"), "left")
    nested = F.struct("record_id", "record_type", "target", "date", "status", "headers", "refers_to", "payload", "payload_bytes")
    none = F.array().cast("array<struct<record_id:string,date:string,payload:binary>>")
    return joined.select(
        F.col("record_id").alias("capture_id"),
        "page_id",
        "refers_to_page_id",
        "declared_digest",
        "declared_bytes",
        "payload_digest",
        nested.alias("response"),
        "request",
        F.coalesce("metadata", none).alias("metadata"),
    )

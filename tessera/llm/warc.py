"""WARC archives: writing crawled pages as transactions, and reading them back into one nested row per capture.

A capture is three records: the request, the response (or a revisit of an equal earlier payload) and metadata.
Request and metadata name the response's record in WARC-Concurrent-To. Reading parses records from archive files and
joins the three through that identifier.

Archives are written and read by Spark's own file sources (text with the records' CRLF CRLF as line separator, and
whole binary files of a bounded size), so any file system that Spark knows will do. The payload moves
in the shuffles that place a page beside its duplicate and no further: assembling joins headers, not payloads.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, text_or_empty, written

VERSION = "WARC/1.1"
#: Bytes of transactions that are written as one row, and rows of a file: a reader holds one file at a time, which is
#: at most their product, if no transaction is larger.
BUNDLE_BYTES = 4 << 20
BUNDLES_PER_FILE = 8
#: Fixed date of the synthetic crawl: records are a function of their page alone.
CRAWL_DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: str) -> str:
    """A record without its closing CRLF CRLF, which the writer puts."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {CRAWL_DATE}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block.encode())}"]
    return _CRLF.join(lines) + _CRLF * 2 + block


def _uri(url: str | None) -> str:
    """A URL as a header's value: control characters and white space are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """``page_id, url, payload, refers_to``: of records with equal payloads of ``min_bytes`` or more, the one with the
    largest id is the response (refers_to null) and the others revisit it. Null payloads are empty. Equality is that
    of SHA-256 digests. Of rows that repeat id and payload, all are responses."""
    src = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(F.col(payload_col)).alias("payload"))
    src = src.withColumn("sha", F.unhex(F.sha2(F.col("payload").cast("binary"), 256)))
    # groups of one need no partner; both sides of the join are shuffled, so Spark can split a hot payload
    twins = written(src.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "payloads")
    return src.join(twins, "sha", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write every row of ``pages`` as a transaction into archive files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def bundle():
            nonlocal held
            whole = (_CRLF * 2).join(out)
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.string())], ["value"])

        for batch in batches:
            for page, url, payload, refers in ((v.as_py() for v in row) for row in zip(*batch.columns, strict=True)):
                name = "null" if page is None else str(page)
                rid = lambda kind, n: f"<urn:tessera:{kind}:{n}>"
                target, body = _uri(url), payload.encode()
                own = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{payload_digest(body)}")]
                http = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: {len(body)}{_CRLF}{_CRLF}"
                if refers is None:
                    main = _record("response", rid("response", name), [*own, ("Content-Type", "application/http; msgtype=response")], http + payload)
                else:
                    link = [("WARC-Refers-To", rid("response", refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    main = _record("revisit", rid("response", name), [*own, *link, ("Content-Type", "application/http; msgtype=response")], http)
                at = ("WARC-Concurrent-To", rid("response", name))
                host = target.split("/")[2] if target.count("/") > 1 else ""
                request = _record("request", rid("request", name), [("WARC-Target-URI", target), at, ("Content-Type", "application/http; msgtype=request")], f"GET {target} HTTP/1.1{_CRLF}Host: {host}{_CRLF}{_CRLF}")
                meta = _record("metadata", rid("metadata", name), [("WARC-Target-URI", target), at, ("Content-Type", "application/warc-fields")], f"pageId: {name}{_CRLF}")
                out += [request, main, meta]
                held += len(main)
                if held >= BUNDLE_BYTES:
                    yield bundle()
        if out:
            yield bundle()

    records = mark_revisits(pages, id_col, url_col, payload_col, min_bytes).mapInArrow(run, "value string")
    records.write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", BUNDLES_PER_FILE).option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive, by its Content-Length. Header names are lower-cased;
    ``warc-version`` holds the version."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        version, *lines = data[at:head].decode("utf-8").split("\r\n")
        headers = {"warc-version": version}
        for line in lines:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        start = head + 4
        if start + size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, data[start : start + size]
        at = start + size
        if data.startswith(b"\r\n\r\n", at):
            at += 4


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """``type, id, concurrent_to, refers_to, target_uri, declared_digest, block_bytes, payload_bytes, payload_digest, fields, payload`` of each record.

    The payload is what follows the HTTP header in responses; its size and digest are computed from its bytes. It is
    returned only if ``payloads`` is set.
    """
    names = ["type", "id", "concurrent_to", "refers_to", "target_uri", "declared_digest", "block_bytes", "payload_bytes", "payload_digest", "fields", "payload"]
    types = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for file in batch.column(0):
                members, view = [], memoryview(file.as_buffer())
                while len(view):  # one gzip member after another
                    d = zlib.decompressobj(31)
                    members += [d.decompress(view), d.flush()]
                    view = memoryview(d.unused_data)
                rows, held = [], 0
                for h, block in parse_records(b"".join(members)):
                    payload = None
                    if h["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                    fields = block.decode("utf-8", "replace") if h["warc-type"] in ("metadata", "request") else None
                    declared = h.get("warc-payload-digest", "").partition(":")[2] or None
                    rows.append((
                        h["warc-type"], h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), declared, len(block),
                        None if payload is None else len(payload), None if payload is None else payload_digest(payload), fields, payload if payloads else None,
                    ))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, ["string"] * 6 + ["bigint", "bigint", "string", "string", "binary"], strict=True)))


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``id``, ``capture`` (the response or revisit), ``request`` and ``metadata`` as structs
    (null where there is none), joined through the concurrent-to identifiers; ``source`` is the response that a
    revisit refers to, of that name and of the digest that the revisit declares. If several requests or metadata records name one capture, the one with the least id is taken."""
    row = lambda name: F.struct("type", "id", "refers_to", "target_uri", "declared_digest", "block_bytes", "payload_bytes", "payload_digest", "fields", "payload").alias(name)
    captures = records.where(F.col("type").isin("response", "revisit")).select(F.col("id"), row("capture"))
    side = lambda kind: records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("id")).agg(F.min_by(row(kind), F.col("id")).alias(kind))
    whole = captures.join(side("request"), "id", "left").join(side("metadata"), "id", "left")
    # one row for each name and digest, as records of one name may be several
    found = captures.where("capture.type = 'response'").groupBy(F.col("id").alias("_source"), F.col("capture.payload_digest").alias("_digest")).agg(F.min("capture.payload_bytes").alias("_bytes"))
    found = found.select("_source", "_digest", F.struct(F.col("_source").alias("id"), F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest")).alias("source"))
    return whole.join(found, (F.col("capture.refers_to") == F.col("_source")) & (F.col("capture.declared_digest") == F.col("_digest")), "left").drop("_source", "_digest")


def page_number(record_id: Column) -> Column:
    """The page of a record that :func:`write_archives` has named; null for a null id."""
    return F.regexp_extract(record_id, ":([^:>]*)>$", 1).try_cast("bigint")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives into the shared folder, read them back and return the assembled captures.

    Ids name the records. Rows that repeat an id are written each and come back once each; null ids are named ``null``. Null payloads are empty; an empty table gives no captures.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, min_bytes)
    return assemble(written(read_records(spark, path), "warc-records"))

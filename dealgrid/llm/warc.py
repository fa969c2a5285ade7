"""WARC archives from a chunked record table (operator 8).

A payload is streamed as rows (record_id, chunk_no, chunk) of at most ``CHUNK`` bytes; each
row carries the running SHA-1 of the payload up to its end, so a reader checks every chunk
as it comes and never holds a whole record.  In the archive a chunk is one WARC record: the
first a ``response``, the others ``continuation`` records with their segment numbers.  A
payload that a record with a larger page_id holds too is a ``revisit`` without a block.

Spark's text writer makes the files (line separator CRLF, gzip) and its reader streams
their lines back, so any file system that Spark reaches will do.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dealgrid.llm.common import small_side, written

CHUNK = 128 << 10
MIN_REVISIT = 1000      # bytes from which equal payloads are stored once
DATE = "2024-01-01T00:00:00Z"
_FLUSH = 8 << 20


def record_plan(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Of the rows with equal payloads of ``min_revisit`` bytes or more, those with the largest
    page_id are responses (rows that repeat it all are), the others revisit it; a row without
    a page_id revisits too, unless no row with that payload has one.  A null html is empty."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    again = written(rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(
        F.count("*").alias("n"), F.max("page_id").alias("keep")).where("n > 1 and keep is not null").select("payload_digest", "keep"), "warc-repeats")
    # A payload that a third of the pages share meets one row: salted if it is a shuffle join.
    salts = 32
    again = again.withColumn("salt", F.explode(F.expr(f"sequence(0, {salts - 1})")))
    joined = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(page_id, url), {salts}) as int)")).join(
        small_side(written(again, "warc-salted"), 64), ["payload_digest", "salt"], "left")
    revisit = F.col("keep").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("keep")))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("keep")).alias("refers_to"))


def chunks(payload: memoryview, size: int):
    """(number, bytes, running SHA-1) of a UTF-8 payload, cut between characters."""
    digest, at, number = hashlib.sha1(), 0, 1
    while at < len(payload) or number == 1:
        end = min(at + size, len(payload))
        while end < len(payload) and end > at + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        digest.update(payload[at:end])
        yield number, payload[at:end], digest.copy().hexdigest()
        at, number = end, number + 1


def _header(fields: list[tuple[str, object]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"


def _records(size: int):
    """WARC records as text rows, chunk by chunk."""
    def run(batches):
        for batch in batches:
            ids, urls, html, length, digest, kind, refers = (batch.column(i) for i in range(7))
            out, held = [], 0
            for i in range(batch.num_rows):
                page, url = ids[i].as_py(), urls[i].as_py()
                uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                own = hashlib.md5(f"{page}|{url}|{digest[i].as_py()}".encode()).hexdigest()
                own = f"<urn:uuid:{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:]}>"
                base = [("WARC-Target-URI", uri), ("WARC-Date", DATE), ("X-Page-Id", page), ("X-Payload-Length", length[i].as_py()),
                        ("WARC-Payload-Digest", f"sha1:{digest[i].as_py()}")]
                if kind[i].as_py() == "revisit":
                    out.append(_header([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *base,
                                        ("WARC-Refers-To", f"<urn:page:{refers[i].as_py()}>"), ("Content-Length", 0)]) + "\r\n")
                    continue
                total = length[i].as_py()
                for number, block, running in chunks(memoryview(html[i].as_buffer()), size):
                    one = total <= size and number == 1
                    record = own if number == 1 else f"{own[:-1]}-{number}>"
                    fields = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", record), *base,
                              ("WARC-Segment-Number", None if one else number), ("WARC-Segment-Origin-ID", own if number > 1 else None),
                              ("X-Running-Digest", f"sha1:{running}"), ("Content-Type", "text/html"), ("Content-Length", len(block))]
                    out.append(_header(fields) + str(block, "utf-8") + "\r\n")
                    held += len(block)
                    if held > _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    return run


def write_warc(pages: DataFrame, path: str, chunk: int = CHUNK, min_revisit: int = MIN_REVISIT) -> None:
    """Archive files of ``pages`` (page_id, url, html) below ``path``, gzip-compressed.

    A task writes one file, which its read partition bounds: the text writer counts rows, so
    that rolling to a new file (whatever the session sets) could part a payload's chunks."""
    records = record_plan(pages, min_revisit).mapInArrow(_records(chunk), "value string")
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 0).text(path)


def _parse(batches):
    """Lines of whole archive files, in order, to one row for each record."""
    fields: dict[str, str] | None = None
    left, digest, parts = None, None, 0
    open_record: dict | None = None
    rows: list[dict] = []

    def close():
        if open_record is not None:
            rows.append({**open_record, "payload_digest": open_record.pop("sha").hexdigest()} if "sha" in open_record else open_record)

    for batch in batches:
        for line in batch.column(0):
            raw = line.as_buffer()
            if left is not None:  # inside a block: the separator belongs to it while bytes are missing
                take = memoryview(raw)[:left]
                digest.update(take)
                left -= len(take)
                if left > 0:
                    sep = b"\r\n"[:left]
                    digest.update(sep)
                    left -= len(sep)
                    if left > 0:
                        continue
                if fields.get("X-Running-Digest") not in (None, f"sha1:{digest.copy().hexdigest()}"):
                    raise ValueError(f"damaged block in {fields['WARC-Record-ID']}")
                open_record["payload_bytes"] += int(fields["Content-Length"])
                left, fields = None, None
                continue
            text = raw.to_pybytes().decode("utf-8")
            if text == "WARC/1.1" and fields is None:
                fields = {}
            elif fields is not None and text:
                name, _, value = text.partition(": ")
                fields[name] = value
            elif fields is not None:  # the header's end
                if fields["WARC-Type"] != "continuation":
                    close()
                    page = fields.get("X-Page-Id")
                    open_record = {"page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"),
                                   "payload_bytes": 0, "record_type": fields["WARC-Type"], "refers_to": None}
                    digest = hashlib.sha1()
                if fields["WARC-Type"] == "revisit":
                    open_record |= {"payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"][5:],
                                    "refers_to": int(fields["WARC-Refers-To"][10:-1])}
                    fields = None
                else:
                    open_record["sha"] = digest
                    left = int(fields["Content-Length"])
        if len(rows) > 1000:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
            rows = []
    close()
    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of the archives below
    ``path``.  Bytes and digest of a response are recomputed from its blocks, chunk by chunk; a
    damaged block stops the job.  gzip files are read whole by one task each, in order."""
    lines = spark.read.option("lineSep", "\r\n").schema("value string").text(path)
    return lines.mapInArrow(_parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")

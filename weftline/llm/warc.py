"""WARC archives: a writer that stores revisits, and a splittable reader.

Archives are gzip files with one member a record. The reader splits files into
byte ranges: a task scans its range for the gzip magic, accepts a candidate only
if it decodes to a WARC header, and owns the records that start inside its range,
reading beyond the end for the last one. No index is needed, and a file of any
size spreads over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, checkpointed, list_files, small_or_shuffled, write_binary_files

MAGIC = b"\x1f\x8b\x08"
ID = "urn:page:"
#: Payloads below this size are always stored; a revisit record would save nothing.
LEAST_BYTES = 100
SPLIT_BYTES = 8 << 20
PIECE = 1 << 16

RECORD_SCHEMA = (
    "file string, offset long, stored_bytes long, record_id string, warc_type string, target_uri string, "
    "warc_date string, payload_digest string, refers_to string, payload_length long, payload binary"
)


def with_record_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response).

    Of the pages with equal payloads of at least `least_bytes`, those with the
    smallest page_id are responses and the others revisit it. Only ids and digests
    are grouped and joined; the payloads join with the table of revisits, which is
    broadcast if it is counted to be small, and otherwise shuffled. A null html is
    an empty payload; a null page_id is never the smallest one beside others.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    page = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    ids = page.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest")
    first = ids.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    known = "coalesce(cast(page_id as string), 'null')"
    revisits = checkpointed(
        ids.join(first.where("n > 1").drop("n"), "payload_digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.expr(known).alias("known"), "payload_digest", "refers_to").distinct()
    )
    return page.withColumn("known", F.expr(known)).join(
        small_or_shuffled(revisits, 150), ["known", "payload_digest"], "left"
    ).drop("known")


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that ends in a zero byte, as the writer of files needs it.

    The last byte is the highest of the size; where that isn't 0 (16 MiB and
    more), an empty member follows, which readers skip.
    """
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    if out[-1]:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += z.compress(b"") + z.flush()
    return out


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode()]
    for name, value in fields:
        if value is not None:
            lines.append(f"{name}: {' '.join(str(value).split())}".encode())
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def encode_pages(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    out: list[bytes] = [member(record("warcinfo", [("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))]
    held = 0
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
        for cells in zip(*columns, strict=True):
            page_id, url, payload, digest, refers_to = (c.as_py() for c in cells)
            fields = [
                ("WARC-Record-ID", f"<{ID}{'null' if page_id is None else page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
                ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)),
                ("Content-Type", "application/http;msgtype=response"),
            ]
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
            if refers_to is None:
                data = record("response", fields, head + payload)
            else:
                fields += [("WARC-Refers-To", f"<{ID}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                data = record("revisit", fields, head)
            out.append(member(data))
            held += len(out[-1])
            if held > PIECE * 32:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for each row of page_id, url, html; a file a partition."""
    bounded_batches(pages.sparkSession)
    typed = with_record_types(pages)
    write_binary_files(typed.mapInArrow(lambda it: encode_pages(it, date), "value binary"), path)


def open_input(uri: str):
    """A random-access file of any file system that Arrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    for old, new in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = new + uri.removeprefix(old) if uri.startswith(old) else uri
    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


class Range:
    """The bytes of a file from `start` on, read ahead as far as asked for."""

    def __init__(self, source, start: int, end: int):
        self.source, self.base, self.size = source, start, source.size()
        self.data = bytearray(source.read_at(min(end + 2, self.size) - start, start))

    def upto(self, at: int) -> None:
        """Hold at least the bytes before `at`, if the file has them."""
        have = self.base + len(self.data)
        if at > have and have < self.size:
            self.data += self.source.read_at(min(max(at - have, 16 * PIECE), self.size - have), have)

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """The member at `at` and its length, or None unless it is a WARC record."""
        z, out, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                self.upto(pos + PIECE)
                piece = bytes(self.data[pos - self.base : pos - self.base + PIECE])
                if not piece:
                    return None
                out.append(z.decompress(piece))
                if pos == at and not out[0].startswith(b"WARC/1."):
                    return None
                pos += len(piece)
        except zlib.error:
            return None
        return b"".join(out), pos - len(z.unused_data) - at


def parse(data: bytes) -> dict | None:
    """Headers by lower-case name, and the payload; None if the record isn't whole."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = fields.get("content-length", "")
    if not gap or not length.isdigit() or len(rest) < int(length):
        return None
    block = rest[: int(length)]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return fields | {"payload": block}


def records_in(source, start: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """offset, stored bytes and fields of the records that start in [start, end)."""
    window, pos = Range(source, start, end), start
    while True:
        found = window.data.find(MAGIC, pos - window.base)
        at = window.base + found
        if found < 0 or at >= end:
            return
        got = window.inflate(at)
        fields = parse(got[0]) if got else None
        if fields is None:
            pos = at + 1
        else:
            yield at, got[1], fields
            pos = at + got[1]
            if pos >= end:
                return


def scan_ranges(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            with open_input(r["path"]) as source:
                for at, stored, x in records_in(source, r["start"], r["end"]):
                    rows.append((
                        r["path"], at, stored, x.get("warc-record-id"), x.get("warc-type"), x.get("warc-target-uri"), x.get("warc-date"),
                        x.get("warc-payload-digest"), x.get("warc-refers-to"), int(x.get("x-payload-length", len(x["payload"]))), x["payload"],
                    ))
                    held += len(x["payload"])
                    if held > PIECE * 64 or len(rows) >= 1000:
                        yield flush()
                        rows, held = [], 0
    if rows:
        yield flush()


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each record of the archives below `path`; a folder without records gives none."""
    files = list_files(spark, path)
    total = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    ranges = files.select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"), "length"
    ).select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end"))
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in RECORD_SCHEMA.split(", ")])
    return ranges.repartition(int(total)).mapInArrow(lambda it: scan_ranges(it, schema), RECORD_SCHEMA)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """The contract's columns, from the archives: a response's digest and size are
    taken from the payload as it was read, a revisit's from its headers.

    A null page is an empty payload; a null page_id stays null and is no page that
    others refer to; repeated page rows give a record each; long pages are read whole;
    no archives give no rows."""
    stored = F.col("warc_type") == "response"
    number = lambda c: F.regexp_extract(c, rf"^<{ID}(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("bigint"))
    return read_warc(spark, path).where(F.col("warc_type").isin("response", "revisit")).select(
        as_id("record_id").alias("page_id"),
        F.when(stored, F.length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        as_id("refers_to").alias("refers_to"),
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

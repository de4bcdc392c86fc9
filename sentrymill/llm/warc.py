"""WARC archives: writing, and a splittable reader.

Writing: every record is a gzip member of its own, and Spark's text writer puts members into files one after another, with its commit
protocol.  The writer ends each value with a separator of one byte.  A gzip member ends with the size of its data in four bytes, low
byte first, so the last byte of any member of less than 16 MB of data is zero: members are handed over without it and
the separator, a zero byte, completes them.  A larger record is followed by an empty member, which ends in zero bytes as well.
The files are plain concatenations of members, as any WARC reader expects.

Payloads that repeat: of records with equal payloads of ``least`` bytes or more, the one with the largest id is written as a response,
the others as revisits that name it.

Reading: files are cut into byte ranges.  A task scans its range for the gzip magic and takes a place for a member's start if
the bytes there inflate to a WARC version line; it owns the records that start inside its range, reads the last one beyond the
range's end, and skips from the end of one member to the next, so magic bytes inside compressed data are not even tried.  No
index and no reading from a file's start is needed.

Files are opened through Arrow's file systems by the paths that Spark lists, so archives must lie in a store that these know.

Defined cases: a null payload is empty; a null id is written with an empty id and read back as null; it is never
referred to, and revisits the row with an id that holds its payload; a null URI is left out; no rows give no records; rows of one id are records of their own; damaged bytes between
members are skipped.  Extra columns are not written.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.llm.common import column, ready, stored

LEAST = 1_000
#: Copies of a row that stands for a repeated payload, so that a payload held by many rows is not one task of the join.
SPREAD = 16
RANGE, BUFFER = 8 << 20, 1 << 18
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1\r\n"
_DATE = "2020-01-01T00:00:00Z"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member, the same bytes for the same data."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def record(kind: str, identity: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; the full payload's size is kept in a header of its own, as a revisit has no payload."""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{identity}')}>"),
               ("WARC-Date", _DATE), ("X-Page-ID", identity or ""), ("X-Payload-Length", str(len(payload))),
               ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("Content-Type", "text/html; charset=utf-8")]
    if uri is not None:
        headers.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("X-Refers-To-Page", refers_to or "")]
    body = payload if kind != "revisit" else b""
    headers.append(("Content-Length", str(len(body))))
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and body, or None if this is no whole record."""
    if not data.startswith(b"WARC/"):
        return None
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        return None
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        return None
    return headers, rest[:int(size)]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                   least: int = LEAST) -> None:
    """One record per row, in gzipped archives under ``folder``."""
    ready(pages.sparkSession)
    payload = F.coalesce(column(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(column(id_col).cast("long").alias("id"), column(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    digests = stored(rows.select("id", F.sha1("payload").alias("digest"), F.length("payload").alias("size")))
    holders = (digests.where(F.col("size") >= least).groupBy("digest")
               .agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
               .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt")))
    # only ids move by digest, and a digest that many rows hold goes to SPREAD tasks; payloads move once, by id
    refers = (digests.where(F.col("size") >= least).select("id", "digest").distinct()
              .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).join(holders, ["digest", "salt"])
              .where("not (id <=> first)").select(F.col("id").alias("_id"), F.col("digest").alias("of"), "first"))
    joined = (rows.withColumn("digest", F.sha1("payload"))
              .join(refers, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("of")), "left")
              .select("id", "uri", "payload", "digest", "first"))

    def members(batches):
        for batch in batches:
            out = []
            for identity, uri, data, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = "response" if first is None else "revisit"
                full = record(kind, None if identity is None else str(identity), uri, data, digest, None if first is None else str(first))
                packed = member(full)
                if packed[-1]:
                    packed += member(b"")
                out.append(packed[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    joined.mapInArrow(members, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(folder)


class _Window:
    """Bytes of a file around a moving place, a buffer at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, place: int, least: int = 1) -> bytes:
        """The bytes from ``place`` on, at least this many unless the file ends."""
        if not self.start <= place or place + least > self.start + len(self.data):
            self.file.seek(place)
            self.start, self.data = place, self.file.read(max(least, BUFFER))
        return self.data[place - self.start:]


def members_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the WARC records whose member starts in [start, end)."""
    window, at = _Window(file, size), start
    while at < min(end, size):
        data = window.at(at, len(_MAGIC))
        found = data.find(_MAGIC)
        if found < 0:
            at += max(1, len(data) - len(_MAGIC) + 1)  # the magic may span two buffers
            continue
        at += found
        if at >= end:
            return
        unpack, out, place = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof and place < size:
                chunk = window.at(place)
                out.append(unpack.decompress(chunk))
                place += len(chunk)
                if len(out) == 1 and out[0] and not out[0].startswith((b"WARC/")[:len(out[0])]):
                    break  # a header that only looks like one, or a member of other data
        except zlib.error:
            at += 1
            continue
        if unpack.eof:
            if out and (whole := b"".join(out)).startswith(b"WARC/"):
                yield at, whole
            at = place - len(unpack.unused_data)
        else:
            at += 1


def read_archives(spark: SparkSession, folder: str, span: int = RANGE) -> DataFrame:
    """One row per record: path, offset, headers (map), payload (body), digest_ok (the body has the digest named; null for revisits)."""
    ready(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ranges = (files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1,
                                                                                       F.lit(span).cast("long"))).alias("start")))
    # a task for each range: rows of a few bytes would be merged into one task without a number
    ranges = ranges.repartitionByRange(max(1, ranges.count()), "path", "start")

    def run(batches):
        from pyarrow import fs
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Spark lists local files as file:/..., Arrow wants file:///...
                store, name = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and path[6:7] != "/" else path)
                with store.open_input_file(name) as file:
                    held, size = [], 0
                    for offset, data in members_in(file, length, start, start + span):
                        both = parsed(data)
                        if both is None:
                            continue
                        headers, body = both
                        named = headers.get("warc-payload-digest", "").partition(":")[2]
                        ok = None if headers.get("warc-type") == "revisit" else (
                            hashlib.sha1(body, usedforsecurity=False).hexdigest() == named)
                        held.append((path, offset, list(headers.items()), body, ok))
                        size += len(body)
                        if size > 16 << 20:
                            yield _batch(held)
                            held, size = [], 0
                    yield _batch(held)

    return ranges.mapInArrow(run, "path string, offset long, headers map<string,string>, payload binary, digest_ok boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                      ["path", "offset", "headers", "payload", "digest_ok"])


def pages_of(records: DataFrame) -> DataFrame:
    """The headers of records that ``write_archives`` wrote, as columns; digests in lower-case hex."""
    h = F.col("headers")
    return records.select(
        F.when(h["x-page-id"] != "", h["x-page-id"].cast("long")).alias("page_id"), h["warc-target-uri"].alias("url"),
        h["x-payload-length"].cast("long").alias("payload_bytes"), F.substring_index(h["warc-payload-digest"], ":", -1).alias("payload_digest"),
        h["warc-type"].alias("record_type"), h["x-refers-to-page"].cast("long").alias("refers_to"), "payload", "digest_ok")

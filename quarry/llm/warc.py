"""WARC archives of pages, with a two-level capture index.

write_archives() stores each page as a gzip member of its own, a repeated payload as a revisit of the page with
the largest id. build_index() sorts the captures by reversed-host URL key into compressed blocks and keeps a
sparse directory of the blocks' first and last keys and the bytes of their records. lookup() binary-searches directory and block before it reads
the record's byte range; read_all() goes from the blocks to every record.

Files are written by executors through pyarrow's file systems (file, hdfs, s3, gs), under names unique to the
attempt; only names that a finished task has reported are ever read, so lost executors and speculative attempts
leave at most unused files.

Edge cases: null html is an empty payload; null urls have an empty key; null ids sort below all others and
are written like others; rows repeated with one id and payload are each written, as responses if the id is the
group's largest; an empty table gives an empty index; other columns of pages are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

CAPTURES = "page_id long, key string, file string, offset long, length long, digest string"
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines int, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: Column) -> Column:
    """host labels in reverse, then `)` and the rest of the URL without its scheme; the host in lower case."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))


def classify(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with record_type and refers_to: of equal payloads of at least least_bytes the largest page_id is the
    response. Maxima are pre-aggregated; the join's page side is split by AQE where a payload is very common."""
    html = F.coalesce("html", F.lit(""))
    with_digest = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"))
    last = pages.select("page_id", F.sha1(F.encode(html, "UTF-8")).alias("sha1")).groupBy("sha1").agg(F.max("page_id").alias("last"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("last")) & (F.octet_length("html") >= least_bytes)
    return with_digest.join(last, "sha1").select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> tuple[bytes, str]:
    """A WARC record and its payload digest; a revisit keeps the HTTP head alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if kind == "revisit" else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> tuple:
    """A row of RECORDS from one record's bytes; a response's payload is digested anew and its length measured."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda s: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", s)) else None
    page_id, url, digest = number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return page_id, url, int(re.search(rb"Content-Length: (\d+)", http)[1]), digest, "revisit", number(fields["WARC-Refers-To"]), None
    own = base64.b32encode(hashlib.sha1(body).digest()).decode()
    if own != digest:
        raise ValueError(f"page {page_id}: payload digest {own}, header {digest}")
    return page_id, url, len(body), own, "response", None, body


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", roll: int = 1 << 30, level: int = 4) -> DataFrame:
    """Write pages as WARC files under folder; the captures, one row a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, kind, refers_to, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, digest = record(page_id, url, html.encode(), kind, refers_to, date)
                packer = zlib.compressobj(level, wbits=31)
                data = packer.compress(data) + packer.flush()
                if out is None or at + len(data) > roll:
                    if out:
                        out.close()
                    name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                out.write(data)
                rows.append((page_id, key, name, at, len(data), digest))
                at += len(data)
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "key", "file", "offset", "length", "digest"])
        if out:
            out.close()

    chosen = classify(pages, least_bytes).select("page_id", "url", "html", "record_type", "refers_to", url_key(F.col("url")).alias("key"))
    return materialise(chosen.mapInArrow(run, CAPTURES), f"{folder}/captures")


def build_index(captures: DataFrame, folder: str, lines: int = 1024) -> DataFrame:
    """Sort captures by key into compressed blocks of `lines` captures; the sparse directory, one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, at, held, out, rows = f"{folder}/{uuid.uuid4().hex}.idx", 0, [], None, []

        def flush() -> None:
            nonlocal at, held, out
            data = zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in held).encode())
            if out is None:
                store, path = fs.FileSystem.from_uri(name)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(path, compression=None)
            out.write(data)
            rows.append((held[0][0], held[-1][0], name, at, len(data), len(held), sum(x[4] for x in held)))
            at, held = at + len(data), []

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(x)
                if len(held) == lines:
                    flush()
        if held:
            flush()
        if out:
            out.close()
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in DIRECTORY.split(", ")])

    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return materialise(ordered.mapInArrow(run, DIRECTORY), f"{folder}/directory")


def _range(cache: dict, name: str, offset: int, length: int) -> bytes:
    """A byte range of a file; handles of the few files of a task stay open."""
    from pyarrow import fs

    if name not in cache:
        if len(cache) >= 16:
            cache.popitem()[1].close()
        store, path = fs.FileSystem.from_uri(name)
        cache[name] = store.open_input_file(path)
    return cache[name].read_at(length, offset)


def read_all(directory: DataFrame, payloads: bool = False, slab: int = 4 << 20) -> DataFrame:
    """Every record that the index knows, read back from the archives by byte range, in file order within a task.

    A task reads some slabs, stretches of one file, so tasks grow with the bytes of the records, not with the pointers."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                found = [json.loads(x)[2:] for x in zlib.decompress(_range(opened, name, offset, length)).decode().split("\n")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for i in range(0, len(places), 1000):
                found = [parse(zlib.decompress(_range(opened, *p), wbits=31)) for p in places[i : i + 1000]]
                found = [x if payloads else (*x[:-1], None) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RECORDS.split(", ")])

    places = directory.select("file", "offset", "length").mapInArrow(blocks, "file string, offset long, length long")
    total = directory.agg(F.sum("bytes")).first()[0] or 0
    bits = max(slab.bit_length() - 1, int(total // 20_000).bit_length())  # larger where that would make too many tasks
    # A number of partitions that is asked for is not coalesced by the size of the pointers.
    return places.repartition(max(1, -(-total // (1 << bits))), "file", F.shiftright("offset", bits)).sortWithinPartitions("file", "offset").mapInArrow(records, RECORDS)


def lookup(spark: SparkSession, directory: DataFrame, url: str) -> list[tuple]:
    """The records of one URL: the directory's matching blocks, a binary search in each, then range reads."""
    key = spark.range(1).select(url_key(F.lit(url))).first()[0]
    opened: dict = {}
    out = []
    # Blocks are sorted, so all but the neighbours of the key are skipped by the directory's column statistics.
    for d in directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).toLocalIterator():
        rows = [json.loads(x) for x in zlib.decompress(_range(opened, d.file, d.offset, d.length)).decode().split("\n")]
        at = bisect.bisect_left(rows, key.encode(), key=lambda r: r[0].encode())
        while at < len(rows) and rows[at][0] == key:
            out.append(parse(zlib.decompress(_range(opened, *rows[at][2:]), wbits=31)))
            at += 1
    return out


def round_trip(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write, index and read back: page_id, payload_bytes, payload_digest, record_type and refers_to of each record."""
    captures = write_archives(pages, f"{folder}/warc", least_bytes)
    return read_all(build_index(captures, f"{folder}/index")).drop("url", "payload")


#: DuckDB has no base32, so the digest's bits are cut in fives: each 5 hex digits give 4 letters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
b AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1), '' ORDER BY i) AS digest
  FROM (SELECT h, CAST(unnest(range(0, 32)) AS INTEGER) AS i FROM m) GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p JOIN m USING (h) JOIN b USING (h)
"""

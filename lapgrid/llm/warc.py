"""WARC archives: a normaliser of monolithic gzip files, with payload deduplication.

``write_archives`` puts each page into a WARC file that is one gzip stream.
``normalise`` inflates each such file once, as a stream, and rewrites every
record as a gzip member of its own, with a sidecar file of offsets beside it
(page, type, offset and length, tab-separated) and the same rows as a table.
Records whose payload equals that of an earlier page become revisits on the
way; only ids and digests are shuffled, never payloads.  ``read_records`` seeks
to single members by that index.

Files go to the shared folder under names of their own for each attempt, and
only those named by the committed table are read, so lost executors do no harm.
An archive closes at ARCHIVE_BYTES of payload or ARCHIVE_RECORDS records, so
one task's work on it is bounded, and rewriting and reading are dealt over as many tasks as there are archives.  Pages
with one payload, such as empty ones, are dealt in parts (spread.py).

Null html is an empty payload; a null url is written as urn:page:<id>.  The
response among equal payloads is the one with the smallest page_id, null ids
last; among rows with the same id any one is, the others revisit it.  An empty
table writes nothing.  A truncated archive raises ValueError.  A very large payload is written and read
whole, one record at a time.  Columns beyond page_id, url and html, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, documents, fresh_path
from .spread import with_group

ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _id(value) -> int | None:
    return None if value is None or value != value else int(value)


def _record(kind: str, page_id, url: str, payload: bytes | None, size: int, digest: str, refers_to=None) -> bytes:
    """A whole record.  payload None: a revisit, whose block has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers by lower-case name, the HTTP headers and the payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _urn(text: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text)
    return int(found[1]) if found else None


def _inflated(stream, name: str) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces."""
    z, data, done = zlib.decompressobj(31), b"", True
    while data or (data := stream.read(_CHUNK)):
        done = False
        yield z.decompress(data)
        data = b""
        if z.eof:
            data, z, done = z.unused_data, zlib.decompressobj(31), True
    if not done:
        raise ValueError(f"{name} ends within a gzip stream")


def _records(pieces: Iterator[bytes], name: str) -> Iterator[bytes]:
    """Whole records out of a stream of text."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError(f"{name} ends within a header")
            return
        size = end + 8 + int(re.search(rb"\r\nContent-Length: *(\d+)", bytes(held[:end]), re.I)[1])
        while len(held) < size and more():
            pass
        if len(held) < size:
            raise ValueError(f"{name} ends within a record")
        yield bytes(held[:size])
        del held[:size]


def write_archives(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes monolithic archives; gives (archive, idx, page_id, payload_bytes, digest) for each record.  Take it once, into a table."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out = z = name = None
        size = n = 0
        for b in batches:
            rows = []
            for page_id, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
                if out is None:
                    name = f"raw-{uuid.uuid4().hex}.warc.gz"
                    out, z, size, n = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, wbits=31), 0, 0
                payload, page_id = (html or "").encode("utf-8", "surrogatepass"), _id(page_id)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
                out.write(z.compress(_record("response", page_id, target, payload, len(payload), digest)))
                rows.append((name, n, page_id, len(payload), digest))
                size, n = size + len(payload), n + 1
                if size >= ARCHIVE_BYTES or n >= ARCHIVE_RECORDS:
                    out.write(z.flush())
                    out.close()
                    out = None
            frame = pd.DataFrame(rows, columns=["archive", "idx", "page_id", "payload_bytes", "digest"])
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.write(z.flush())
            out.close()

    schema = "archive string, idx long, page_id long, payload_bytes long, digest string"
    return pages.select("page_id", "url", "html").mapInPandas(write, schema)


def roles(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records with revisit and refers_to, by groups of equal payloads of at least min_bytes."""
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "idx")
    same = with_group(records.where(F.col("payload_bytes") >= min_bytes), ["digest", "payload_bytes"], ["archive", "idx"], {"first": (rank, "min")})
    later = ~((F.col("archive") == F.col("first.archive")) & (F.col("idx") == F.col("first.idx")))
    alone = records.where(F.col("payload_bytes") < min_bytes).select("archive", "idx", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))
    return same.select("archive", "idx", later.alias("revisit"), F.when(later, F.col("first.page_id")).alias("refers_to")).unionByName(alone)


def normalise(record_roles: DataFrame, source: str, folder: str, tasks: int, level: int = 3) -> DataFrame:
    """Rewrites archives record by record, in so many tasks; gives the offset index.  Take it once, into a table."""

    def rewrite(group: pd.DataFrame) -> pd.DataFrame:
        name = group["archive"].iloc[0]
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        source_fs, source_root = _open(source)
        role = dict(zip(group["idx"], zip(group["revisit"], group["refers_to"], strict=True), strict=True))
        to = f"{uuid.uuid4().hex}.warc.gz"
        rows, at = [], 0
        with source_fs.open_input_stream(f"{source_root}/{name}", compression=None) as stream, fs.open_output_stream(f"{root}/{to}", compression=None) as out:
            for i, record in enumerate(_records(_inflated(stream, name), name)):
                revisit, refers = role[i]
                fields, _, payload = _parse(record)
                page_id, kind = _urn(fields["warc-record-id"]), "response"
                if revisit:
                    kind, refers = "revisit", _id(refers)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    record = _record(kind, page_id, fields["warc-target-uri"], None, len(payload), digest, refers)
                z = zlib.compressobj(level, wbits=31)
                member = z.compress(record) + z.flush()
                out.write(member)
                rows.append((to, at, len(member), page_id, kind))
                at += len(member)
        with fs.open_output_stream(f"{root}/{to}.idx", compression=None) as side:
            side.write("".join(f"{p}\t{k}\t{o}\t{n}\n" for _, o, n, p, k in rows).encode())
        return pd.DataFrame(rows, columns=["archive", "offset", "length", "page_id", "record_type"]).astype({"page_id": "Int64"})

    return record_roles.repartition(tasks, "archive").groupBy("archive").applyInPandas(rewrite, "archive string, offset long, length long, page_id long, record_type string")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """One row per indexed record, from the archives alone: ids, type, digest, size and payload (null for revisits)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        name = stream = None
        for b in batches:
            rows = []
            for archive, offset, length in zip(b["archive"], b["offset"], b["length"], strict=True):
                if archive != name:
                    name, stream = archive, fs.open_input_file(f"{root}/{archive}")
                fields, http, payload = _parse(zlib.decompress(stream.read_at(length, offset), 31))
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(re.search(rb"\r\nContent-Length: *(\d+)", http)[1])
                if kind == "response":
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (len(payload), own) != (size, digest):
                        raise ValueError(f"{archive} at {offset}: the payload doesn't match its digest")
                rows.append((_urn(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind,
                             _urn(fields.get("warc-refers-to", "")), payload if kind == "response" else None))
            frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    tasks = max(index.select("archive").distinct().count(), 1)
    return index.repartition(tasks, "archive").sortWithinPartitions("archive", "offset").mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes, deduplicates and normalises; gives the offset index and the folder of the archives."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    raw, final = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc-archives")
    records = scratch.table(write_archives(pages, raw), "records")
    tasks = max(records.select("archive").distinct().count(), 1)
    index = scratch.table(normalise(roles(records, min_bytes), raw, final, tasks), "index")
    scratch.drop(records)
    where = spark._jvm.org.apache.hadoop.fs.Path(raw)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return index, final


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = archive_pages(documents(spark, sf_dir, "pages"))
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
 d AS (SELECT page_id, octet_length(b) AS n, min(page_id) OVER (PARTITION BY h, octet_length(b)) AS first,
   array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     ((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS digest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

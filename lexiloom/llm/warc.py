"""WARC archives: records written from pages and read again as a stream.

Every record is a gzip member of its own, so archives can be joined, and cut at records. The reader goes through an archive
once: it decompresses chunk by chunk, takes header lines, then as many bytes as the content length says, and checks the
digests of what passes by; it holds a chunk and a header, not a record, unless payloads are asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import materialize, scratch_dir

CHUNK = 1 << 18
#: A header block longer than this is an error, so that a damaged archive cannot fill memory.
MOST_HEADER = 1 << 16
#: An archive takes no further record once it holds so many bytes.
ARCHIVE_BYTES = 256 << 20
_BATCH_ROWS, _BATCH_BYTES = 1024, 16 << 20
# --- fixed values of the format ---------------------------------------------------------------------------------------
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"


class DamagedArchive(ValueError):
    """What an archive holds is not what the format or its own digests say."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_output(path: str) -> BinaryIO:
    """A new file of any store that Arrow opens: local or mounted folders, HDFS, S3, GCS."""
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at, compression=None)  # else the name decides


def open_input(path: str) -> BinaryIO:
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_stream(at, compression=None)


# --- writing ------------------------------------------------------------------------------------------------------------


def record(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A gzip member with one record. Line ends in values become blanks, so that no value makes a header of its own."""
    lines = [VERSION, *(f"{k}: {re.sub('[\x00-\x1f\x7f]+', ' ', v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """Response with the payload, or, with ``refers_to``, a revisit: HTTP header and digest, no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    block = http if again else http + payload
    headers = [
        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date), ("Content-Type", HTTP_TYPE), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", SAME_PAYLOAD)] if again else []
    return record(headers, block)


def equal_payloads(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(payload, last)``: SHA-256 of payloads of ``least`` bytes or more that several records have, and the largest id."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.filter(F.octet_length(html) >= least).select(F.unhex(F.sha2(html, 256)).alias("payload"), F.col("page_id").cast("long").alias("page_id"))
    return rows.groupBy("payload").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).filter("n > 1 and last is not null").select("payload", "last")


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return ``(path, records, bytes)``, a row per archive.

    Of rows with equal html of ``least`` bytes or more, those with the largest page_id become responses, the others
    revisits of it; all others are responses. Null html is empty. Rows without an id are revisits of equal ones that have
    one, else responses. Rows that repeat id and html have a record each. Other columns are not looked at; an
    empty table gives no archive. ``folder`` is a URI that all executors can write to, by default below
    spark.checkpoint.dir. Archives have names of their own per task attempt, and only those of finished tasks are
    returned, so a lost executor or a second attempt leaves no record twice.
    """
    spark = pages.sparkSession
    folder = f"{folder or scratch_dir(spark) + '/lexiloom'}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    shared = materialize(equal_payloads(rows, least), "payloads")  # small, as a rule: then Spark broadcasts it and no html moves
    told = rows.withColumn("payload", F.unhex(F.sha2("html", 256))).join(shared, "payload", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("last")), None).otherwise(F.col("last"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, path, n, size = [], None, "", 0, 0
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        try:
            for b in batches:
                for page_id, url, html, refers_to in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(b.columns)), strict=True):
                    if out is None:
                        path, n, size = f"{name}-{len(done):04d}.warc.gz", 0, 0
                        out = open_output(path)
                        size += out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: lexiloom\r\nformat: WARC File Format 1.1\r\n"))
                    size += out.write(page_record(page_id, url, html.as_py().encode("utf-8", "surrogatepass"), refers_to, date))
                    n += 1
                    if size >= archive_bytes:
                        out.close()
                        done.append((path, n, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return materialize(told.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(write, "path string, records long, bytes long"), "archives")


# --- reading ------------------------------------------------------------------------------------------------------------


class _Members:
    """Bytes of consecutive gzip members, on demand. ``begin`` is the place of the member being read."""

    def __init__(self, source: BinaryIO, chunk: int) -> None:
        self.source, self.chunk, self.rest, self.at, self.begin = source, chunk, b"", 0, 0
        self.inflate: zlib._Decompress | None = None
        self.ready = b""

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        if not self.rest:
            self.rest = self.source.read(self.chunk)
        self.begin, self.ready = self.at, b""
        self.inflate = zlib.decompressobj(31) if self.rest else None
        return self.inflate is not None

    def more(self) -> bytes:
        """Some bytes of the member; empty at its end."""
        while not self.ready and not self.inflate.eof:
            if not self.rest:
                self.rest = self.source.read(self.chunk)
                if not self.rest:
                    raise DamagedArchive(f"the archive ends within the member at {self.begin}")
            given = self.rest
            try:
                self.ready = self.inflate.decompress(given, self.chunk)
            except zlib.error as e:
                raise DamagedArchive(f"the member at {self.begin} is not gzip: {e}") from None
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.at += len(given) - len(self.rest)
        out, self.ready = self.ready, b""
        return out

    def until(self, mark: bytes, most: int) -> bytes:
        """Up to and with ``mark``."""
        got = b""
        while (i := got.find(mark)) < 0:
            some = self.more()
            if not some or len(got) > most:
                raise DamagedArchive(f"no end of the header in the member at {self.begin}")
            got += some
        self.ready = got[i + len(mark) :] + self.ready
        return got[: i + len(mark)]

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            some = self.more()
            if not some:
                raise DamagedArchive(f"the member at {self.begin} is {n} bytes short of its content length")
            self.ready, some = some[n:], some[:n]
            n -= len(some)
            yield some


def _headers(block: bytes) -> dict[str, str]:
    first, *lines = block.decode("utf-8", "replace").rstrip("\r\n").split("\r\n")
    if not first.startswith("WARC/"):
        raise DamagedArchive(f"a record begins with {first[:40]!r}")
    out: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in " \t" and last:  # a folded line goes on with the one before
            out[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def records(source: BinaryIO, payloads: bool = False, chunk: int = CHUNK) -> Iterator[dict]:
    """The records of an archive, in order; digests that differ raise DamagedArchive."""
    members = _Members(source, chunk)
    while members.next_member():
        head = _headers(members.until(b"\r\n\r\n", MOST_HEADER))
        try:
            left = length = int(head["content-length"])
        except (KeyError, ValueError):
            raise DamagedArchive(f"no content length in the member at {members.begin}") from None
        block, payload, kept, n_payload, stated = hashlib.sha1(), hashlib.sha1(), [], 0, None
        http = head.get("content-type", "").replace(" ", "").startswith("application/http")
        before = b"" if http else None  # of an HTTP message, the header that its payload follows
        for some in members.exactly(left):
            block.update(some)
            if before is not None:
                before += some
                i = before.find(b"\r\n\r\n")
                if i < 0:
                    if len(before) > MOST_HEADER:
                        raise DamagedArchive(f"no end of the HTTP header in the member at {members.begin}")
                    continue
                if m := re.search(rb"(?im)^content-length:[ \t]*(\d+)", before[:i]):
                    stated = int(m[1])
                some, before = before[i + 4 :], None
            payload.update(some)
            n_payload += len(some)
            if payloads:
                kept.append(some)
        tail = b""
        while some := members.more():
            tail += some
            if len(tail) > 4:
                break
        if tail != b"\r\n\r\n":
            raise DamagedArchive(f"the member at {members.begin} does not end after its content length")
        kind, found = head.get("warc-type", ""), {"warc-block-digest": block, "warc-payload-digest": payload}
        for name, sha in found.items():
            given = head.get(name, "")
            if given.lower().startswith("sha1:") and not (kind == "revisit" and sha is payload) and given[5:] != base64.b32encode(sha.digest()).decode():
                raise DamagedArchive(f"{name} of the member at {members.begin} is {given}, its bytes say otherwise")
        if kind == "response" and http and stated is not None and stated != n_payload:
            raise DamagedArchive(f"the HTTP length of the member at {members.begin} is {stated}, its payload has {n_payload}")
        yield {
            "offset": members.begin, "record_type": kind, "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "content_length": length, "payload_bytes": stated if kind == "revisit" else n_payload, "payload_digest": re.sub("(?i)^sha1:", "", head.get("warc-payload-digest") or "sha1:" + base64.b32encode(payload.digest()).decode()),
            "refers_to": head.get("warc-refers-to"), "payload": b"".join(kept) if payloads and kind != "revisit" else None,
        }


RECORD = "path string, offset long, record_type string, record_id string, target_uri string, date string, content_length long, payload_bytes long, payload_digest string, refers_to string"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = False, strict: bool = True) -> DataFrame:
    """A row per record of the archives at ``path``, each read by one task; with ``payloads`` a binary column of them.

    A damaged archive raises; with ``strict`` off, the records before the damage are kept and a row of type ``damaged``
    has what is wrong in ``target_uri``. ``payload_bytes`` of a revisit is the length that its HTTP header states.
    """
    schema, kinds = (RECORD + ", payload binary", [*_KINDS, pa.binary()]) if payloads else (RECORD, _KINDS)
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with open_input(path) as source:
                        for r in records(source, payloads):
                            rows.append([path, *(r[c] for c in names[1:])])
                            size += len(r["payload"] or b"")
                            if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                                yield batch(rows)
                                rows, size = [], 0
                except DamagedArchive as e:
                    if strict:
                        raise DamagedArchive(f"{path}: {e}") from None
                    rows.append([path, None, "damaged", None, str(e), *[None] * (len(names) - 5)])
        if rows:
            yield batch(rows)

    paths = archives.select("path")
    n = paths.count()
    return paths.repartition(max(1, n), "path").mapInArrow(read, schema)


def page_records(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of page records, ids as numbers again."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    kept = records.filter(F.col("record_type").isin("response", "revisit"))
    return kept.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def _sql_base32(sha: str) -> str:
    """Base32 of a SHA-1 in hexadecimal: the bits, five at a time, name letters of the alphabet, a fixed value."""
    bits = f"array_to_string(list_transform(string_split({sha}, ''), lambda x: lpad(bin(('0x' || x)::INT), 4, '0')), '')"
    five = f"list_transform(range(0, 32), lambda i: substring({bits}, 5 * i + 1, 5))"
    value = "list_reduce(list_transform(string_split(b, ''), lambda x: x::INT), lambda a, x: 2 * a + x)"
    return f"array_to_string(list_transform({five}, lambda b: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {value}, 1)), '')"


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, sha1(html) AS sha FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_sql_base32('sha')} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM g"""

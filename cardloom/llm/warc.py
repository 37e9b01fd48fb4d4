"""WARC archives: a writer, and a reader that salvages damaged files.

Writing: equal payloads of at least ``MIN_REVISIT`` bytes are stored once, in the record of the
largest page id; the others are revisit records that point to it. Only digests and ids are
shuffled to find them; the payloads go straight from the scan into the archives, unless more
than ``HOLDERS`` payloads are shared, in which case the rows are joined by digest. Each record is
a gzip member of its own; a task begins another file once ``file_bytes`` compressed bytes are
written. Files have names of their own, and a manifest that Spark commits lists those of the
attempts that counted.

Reading: each file is read as a stream, record by record. A record is good if its version line,
its headers (folded lines among them), its length, its terminator and the digests of its block and
payload hold: MD5, SHA-1, SHA-256 or SHA-512 in base 16, 32 or 64, of a chunked body as it was sent
or put together; other algorithms and forms are not checked. Where a check fails,
the reader searches for the next place at which a record does parse (in compressed files: the
next member that inflates), reports the bytes between as a quarantined gap, and goes on. Memory
holds one record (or member) at a time, whatever the size of the file; headers of more than
``HEAD_BYTES`` count as damage. A file is the work of one task. Files must lie where pyarrow's
file systems reach them.

Defined results: a null html is an empty payload; a null url gets a URN of the page id; pages
that repeat the largest id of a group of equal payloads are all response records, and null ids
count as the smallest; control characters in urls are percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.common import bounded_batches, exists, make_folder, new_folder, open_file, put_file, written

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = re.compile(rb"\x1f\x8b\x08")
#: A line that goes on in the next one.
_FOLD = re.compile(rb"\r\n[ \t]+")
#: Bytes of the digests that are checked.
ALGORITHMS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
#: Compressed bytes after which a task begins another archive.
FILE_BYTES = 64 << 20
#: Most shared payloads whose digests and holders go to every task (about 20 MB).
HOLDERS = 250_000
#: Longest headers of a record; bytes read ahead.
HEAD_BYTES, AHEAD = 1 << 20, 1 << 18
LEVEL = 6
#: Most tasks that read; each then has several files.
MOST_TASKS = 20_000

RECORD = (
    "file string, offset bigint, length bigint, page_id bigint, record_type string, target_uri string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, payload binary, problem string"
)


def write_warc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, date: str = DATE, file_bytes: int = FILE_BYTES, holders: int = HOLDERS) -> str:
    """Write the archives; returns their folder."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or new_folder(spark, "warc")
    make_folder(folder)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("bigint")})
    # pre-aggregated, so that a payload of many pages is no hot group
    shared = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies"))
    shared = written(shared.where("copies > 1 AND holder IS NOT NULL").select("digest", "holder"), "shared-payloads")
    few = shared.count() <= holders
    rows = rows.join(F.broadcast(shared) if few else shared, "digest", "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    body = F.when(~revisit, F.col("html"))
    files = rows.select(_head(revisit, date).alias("head"), body.alias("body")).mapInArrow(_writer(folder, file_bytes), "file string, records bigint, bytes bigint")
    files.write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def _head(revisit, date: str):
    """A record's headers and those of its HTTP response."""
    eol = "\r\n"
    http = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in _split(_HTTP, F.col("size").cast("string"))))
    digits = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "digest").cast("binary"))
    urn = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    url = F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    url = F.replace(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    headers = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), urn),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url), F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"), F.concat(F.lit("X-Page-ID: "), page), F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("holder").cast("string"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(eol, *headers), F.lit(eol + eol), http)


def _split(template: str, value):
    before, after = template.split("{}")
    return [before, value, after]


def _member(head: str, body: str | None) -> bytes:
    """A record as a gzip member."""
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(head.encode()) + press.compress((body or "").encode()) + press.compress(_END) + press.flush()


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (_member(h.as_py(), b.as_py()) for batch in batches for h, b in zip(batch.column("head"), batch.column("body"), strict=True))
        for k, first in enumerate(members):
            held = [0, 0]  # records, bytes

            def some(first: bytes = first, held: list[int] = held) -> Iterator[bytes]:
                for m in chain([first], members):
                    held[0] += 1
                    held[1] += len(m)
                    yield m
                    if held[1] >= file_bytes:
                        return

            name = f"pages-{TaskContext.get().partitionId():06d}-{k:04d}-{uuid.uuid4().hex[:12]}.warc.gz"
            put_file(f"{folder}/{name}", some())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held[0]]), pa.array([held[1]])], names=["file", "records", "bytes"])

    return write


@dataclass
class Found:
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    problem: str | None = None  # of a gap


class _Source:
    """A file read from any place, some way ahead."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        """The ``n`` bytes from ``at`` on, or fewer at the end."""
        n = max(0, min(n, self.size - at))
        if n and not self.at <= at <= at + n <= self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, AHEAD), self.size - at), at)
        return self.held[at - self.at : at - self.at + n] if n else b""

    def find(self, pattern: re.Pattern[bytes], at: int) -> int:
        """Where the next match of at most 16 bytes begins; the end if there is none."""
        while at < self.size:
            hit = pattern.search(self.get(at, AHEAD))
            if hit:
                return at + hit.start()
            at += AHEAD - 16
        return self.size


def _parse(data: _Source, at: int) -> tuple[int, dict[str, str], bytes]:
    """(end, headers, payload) of the record at ``at``, or ValueError."""
    if not _VERSION.match(data.get(at, 16)):
        raise ValueError("no version line")
    ahead = 4096
    while (head := data.get(at, ahead).find(_END)) < 0:
        if ahead >= min(HEAD_BYTES, data.size - at):
            raise ValueError("headers end early")
        ahead *= 4
    headers = {}
    for line in _FOLD.sub(b" ", data.get(at, head)).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isascii() or not headers.get("content-length", "").isdigit():
        raise ValueError("no length")
    start, length = at + head + 4, int(headers["content-length"])
    end = start + length
    if length > AHEAD and data.get(end, 4) != _END:  # before a long block is read
        raise ValueError("no terminator where the length says")
    block = data.get(start, length + 4)
    if block[length:] != _END:
        raise ValueError("no terminator where the length says")
    payload = block = block[:length]
    if headers.get("content-type", "").startswith("application/http"):
        _, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise ValueError("no HTTP headers")
    if not _agrees(headers.get("warc-block-digest", ""), block):
        raise ValueError("the block's digest differs")
    if headers.get("warc-type") != "revisit" and not _agrees(headers.get("warc-payload-digest", ""), payload):
        # some writers take the digest of what was sent in chunks, some of the chunks put together
        head = block[: len(block) - len(payload)].lower()
        whole = _unchunked(payload) if b"transfer-encoding: chunked" in head else None
        if whole is None or not _agrees(headers["warc-payload-digest"], whole):
            raise ValueError("the payload's digest differs")
    return end + 4, headers, payload


def _digest(labelled: str) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a digest header in base 16, 32 or 64; None for other algorithms and forms."""
    name, _, value = labelled.partition(":")
    name = name.strip().lower().replace("-", "")
    size, value = ALGORITHMS.get(name), value.strip().rstrip("=")
    if size is None:
        return None
    try:
        if len(value) == 2 * size:
            return name, bytes.fromhex(value)
        if len(value) == -(-size * 8 // 5):
            return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8))
        if len(value) == -(-size * 8 // 6):
            return name, base64.b64decode(value + "=" * (-len(value) % 4), altchars=b"-_" if set(value) & set("-_") else None)
    except ValueError:
        pass
    return None


def _agrees(labelled: str, data: bytes) -> bool:
    """Whether a digest header is right; one that can't be understood is no damage."""
    known = _digest(labelled)
    return known is None or hashlib.new(known[0], data).digest() == known[1]


def _unchunked(data: bytes) -> bytes | None:
    """The body that HTTP chunks carry, or None."""
    out, at = [], 0
    while (eol := data.find(b"\r\n", at)) >= 0:
        try:
            n = int(data[at:eol].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        out.append(data[eol + 2 : eol + 2 + n])
        at = eol + 4 + n
    return None


def salvage(file: pa.NativeFile | bytes) -> Iterator[Found]:
    """Records and gaps of a file, which cover all its bytes in order."""
    data = _Source(pa.BufferReader(file) if isinstance(file, bytes) else file)
    packed = _MEMBER.match(data.get(0, 3))
    at, bad, problem = 0, None, ""
    while at < data.size:
        try:
            end, found = _from_member(data, at) if packed else _from_plain(data, at)
        except (ValueError, zlib.error) as e:
            if bad is None:
                bad, problem = at, str(e)
            at = data.find(_MEMBER if packed else _VERSION, at + 1)
            continue
        if bad is not None:
            yield Found(bad, at - bad, problem=problem)
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield Found(bad, data.size - bad, problem=problem)


def _from_plain(data: _Source, at: int) -> tuple[int, list[Found]]:
    end, headers, payload = _parse(data, at)
    return end, [Found(at, end - at, headers, payload)]


def _from_member(data: _Source, at: int) -> tuple[int, list[Found]]:
    """(end, records) of the member at ``at``, or an error; the records have the member's place."""
    if not _MEMBER.match(data.get(at, 3)):
        raise ValueError("no gzip member")
    inflate, parts, end = zlib.decompressobj(31), [], at
    while not inflate.eof and end < data.size:
        part = data.get(end, 1 << 16)
        parts.append(inflate.decompress(part))
        end += len(part)
    if not inflate.eof:
        raise ValueError("the member ends early")
    plain, end = b"".join(parts), end - len(inflate.unused_data)
    inside = list(salvage(plain)) if not _MEMBER.match(plain) else []
    if not inside:
        raise ValueError("an empty member")
    return end, [Found(at, end - at, f.headers, f.payload, f.problem) for f in inside]


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record, and one for each gap (``problem`` not null, no other column but its place).

    Reads the files of the folder's manifest, or all files of a folder without one.
    """
    bounded_batches(spark)
    if exists(f"{folder}/manifest"):
        files = spark.read.schema("file string, records bigint, bytes bigint").parquet(f"{folder}/manifest").select(F.concat(F.lit(f"{folder}/"), "file").alias("path"))
    else:
        files = spark.read.format("binaryFile").load(folder).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with open_file(path) as file:
                    for f in salvage(file):
                        rows.append(_row(path, f))
                        held += len(f.payload)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    return files.repartition(max(1, min(files.count(), MOST_TASKS))).mapInArrow(run, RECORD)


def _row(path: str, f: Found) -> tuple:
    if f.problem is not None:
        return (path, f.offset, f.length, None, None, None, None, None, None, None, f.problem)
    h = f.headers
    known = _digest(h.get("warc-payload-digest", ""))
    digest = hashlib.sha1(f.payload).hexdigest() if h.get("warc-type") != "revisit" else known[1].hex() if known and known[0] == "sha1" else None
    size = _number(h.get("x-payload-length")) if h.get("warc-type") == "revisit" else len(f.payload)
    return (path, f.offset, f.length, _number(h.get("x-page-id")), h.get("warc-type"), h.get("warc-target-uri"), _number(h.get("x-refers-to-page-id")), size, digest, f.payload, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

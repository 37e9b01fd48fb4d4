import base64
import gzip
import hashlib
import pathlib

import pyarrow as pa
import pytest

from cardloom.llm import queries, warc

BIG, SMALL = "<p>é</p>" * 200, "<p>x</p>" * 100
PAGES = [(1, "http://a/1", BIG, 0), (2, "http://a/2", BIG, 0), (5, None, BIG, 0), (5, None, BIG, 0), (3, "http://a\r\nX-Page-ID: 9", SMALL, 0), (4, "u", SMALL, 0), (6, "v", None, 0), (7, "w", "", 0),
         (8, "z", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 40, 0), (None, "n", BIG, 0), (9, "y", "\r\n\r\n" * 300, 0)]


def rows_of(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


@pytest.mark.parametrize("few", [0, 1000])
def test_round_trip(spark, few):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int").repartition(3)
    for rows in (PAGES, []):
        found = warc.read_warc(spark, warc.write_warc(df if rows else df.limit(0), file_bytes=300, holders=few))
        assert found.where("problem IS NOT NULL").count() == 0
        want = []
        for i, _, html, _ in rows:
            raw = (html or "").encode()
            revisit = html == BIG and i != 5
            want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
        assert rows_of(found) == sorted(want, key=str)
        for r in found.where("record_type = 'response'").collect():
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest


def archive(spark, n=12):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(n)], "page_id long, url string, html string").coalesce(1)
    folder = warc.write_warc(df)
    (file,) = pathlib.Path(folder.removeprefix("file://")).glob("*.warc.gz")
    return gzip.decompress(file.read_bytes())


def covered(data, found):
    at = 0
    for f in found:
        assert f.offset == at
        at += f.length
    assert at == len(data)


def test_salvage_of_plain_files(spark):
    data = archive(spark)
    records = list(warc.salvage(data))
    covered(data, records)
    ids = [f.headers["x-page-id"] for f in records]
    assert sorted(ids, key=int) == [str(i) for i in range(12)]
    spots = {"a flipped byte": records[4].offset + records[4].length - 30, "the version line": records[4].offset, "the length": data.index(b"Content-Length", records[4].offset) + 16}
    for at in spots.values():
        hurt = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        found = list(warc.salvage(hurt))
        covered(hurt, found)
        gaps = [f for f in found if f.problem]
        assert [(g.offset, g.length) for g in gaps] == [(records[4].offset, records[4].length)]
        assert [f.headers["x-page-id"] for f in found if not f.problem] == ids[:4] + ids[5:]
    junk = b"\x00\xff WARC/1.1\r\njunk" * 5
    mixed = junk + data[: records[2].offset] + junk + data[records[2].offset : -200]
    found = list(warc.salvage(mixed))
    covered(mixed, found)
    assert [f.headers["x-page-id"] for f in found if not f.problem] == ids[:11]
    assert sum(f.problem is not None for f in found) == 3
    assert list(warc.salvage(b"")) == []


def test_salvage_of_gzip_members(spark):
    data = archive(spark)
    records = list(warc.salvage(data))
    ids = [f.headers["x-page-id"] for f in records]
    members = [gzip.compress(data[f.offset : f.offset + f.length]) for f in records]
    assert len(list(warc.salvage(b"".join(members)))) == 12
    hurt = list(members)
    hurt[3] = hurt[3][:40] + bytes([hurt[3][40] ^ 255]) + hurt[3][41:]
    found = list(warc.salvage(b"".join(hurt) + b"tail"))
    assert [f.headers["x-page-id"] for f in found if not f.problem] == ids[:3] + ids[4:]
    gaps = [f for f in found if f.problem]
    assert (gaps[0].offset, gaps[0].length) == (sum(map(len, hurt[:3])), len(hurt[3])) and gaps[1].length == 4


@pytest.mark.parametrize("size", [1, 1 << 30])
def test_pages(spark, size):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = warc.write_warc(pages, file_bytes=size)
    found = warc.read_warc(spark, folder)
    assert rows_of(found) == rows_of(queries.op4_warc(spark, sf)) and found.count() == pages.count()
    assert len(list(pathlib.Path(folder.removeprefix("file://")).glob("*.warc.gz"))) == (pages.count() if size == 1 else pages.rdd.getNumPartitions())


def test_files_of_failed_attempts_and_of_others(spark):
    """The manifest says what counts; a folder without one is read whole."""
    pages = spark.createDataFrame([(i, "u", f"{i}" * 2000) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    folder = warc.write_warc(pages)
    place = pathlib.Path(folder.removeprefix("file://"))
    (file,) = place.glob("*.warc.gz")
    (place / "pages-000000-0000-of-a-lost-attempt.warc.gz").write_bytes(file.read_bytes())
    assert warc.read_warc(spark, folder).count() == 6
    (place / "manifest").rename(place.parent / "elsewhere")
    assert warc.read_warc(spark, folder).count() == 12


def test_long_pages_and_long_files(spark, tmp_path):
    """A page of 50 MB; a plain archive much longer than what is read ahead, hurt in the middle of a long record."""
    df = spark.createDataFrame([(1, "u", 2), (2, "v", 3)], "page_id long, url string, digit int").selectExpr("page_id", "url", "repeat(digit, 50000000) AS html")
    found = warc.read_warc(spark, warc.write_warc(df)).selectExpr("page_id", "payload_bytes", "length(payload) AS n", "problem").orderBy("page_id").collect()
    assert [tuple(r) for r in found] == [(1, 50_000_000, 50_000_000, None), (2, 50_000_000, 50_000_000, None)]
    data = archive(spark)
    first = next(iter(warc.salvage(data)))
    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 1_000_000
    long = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nX-Page-ID: 99\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    hurt = data[: first.length] + long + long[:-500_000] + data[first.length :]
    (tmp_path / "a.warc").write_bytes(hurt)
    with open(tmp_path / "a.warc", "rb") as f:
        found = list(warc.salvage(pa.PythonFile(f)))
    covered(hurt, found)
    assert [f.headers["x-page-id"] for f in found if not f.problem].count("99") == 1 and sum(f.problem is None for f in found) == 13
    assert [(f.offset, f.length) for f in found if f.problem] == [(first.length + len(long), len(long) - 500_000)]


def crawled(payload, digest, *more, http=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", kind="response"):
    """A record as public crawls write it."""
    block = http + payload
    head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:6d0b3a1c-0000-4000-8000-000000000001>", "WARC-Date: 2024-01-01T00:00:00Z", "WARC-Target-URI: http://example.org/a", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}", *more, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_digests_of_other_writers():
    p = b"<html>caf\xc3\xa9</html>"

    def b32(name, data=p):
        return base64.b32encode(hashlib.new(name, data).digest()).decode().rstrip("=")

    chunked = b"5\r\n" + p[:5] + b"\r\n" + b"%x;x=y\r\n" % len(p[5:]) + p[5:] + b"\r\n0\r\n\r\n"
    in_chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    good = [
        crawled(p, "sha1:" + b32("sha1")), crawled(p, "sha1:" + b32("sha1").lower()), crawled(p, "SHA-1:" + hashlib.sha1(p).hexdigest().upper()), crawled(p, "md5:" + hashlib.md5(p).hexdigest()),
        crawled(p, "sha256:" + b32("sha256")), crawled(p, "sha256:" + base64.b64encode(hashlib.sha256(p).digest()).decode()), crawled(p, "sha512:" + base64.urlsafe_b64encode(hashlib.sha512(p).digest()).decode()),
        crawled(p, "blake3:abcdef"), crawled(p, "sha1:short"), crawled(p, "no digest"), crawled(chunked, "sha1:" + b32("sha1"), http=in_chunks), crawled(chunked, "sha1:" + b32("sha1", chunked), http=in_chunks),
        crawled(p, "sha1:" + b32("sha1"), "X-Note: one\r\n\ttwo\r\n  three"), crawled(b"", "sha1:" + b32("sha1"), kind="revisit"),
    ]
    for raw in (b"".join(good), b"".join(gzip.compress(r) for r in good)):
        found = list(warc.salvage(raw))
        assert len(found) == len(good) and all(f.problem is None for f in found)
        assert found[12].headers["x-note"] == "one two three"
    bad = [crawled(p, "sha1:" + b32("sha1", b"x")), crawled(p, "sha256:" + hashlib.sha256(b"x").hexdigest()), crawled(chunked, "md5:" + hashlib.md5(b"x").hexdigest(), http=in_chunks), crawled(p, "sha1:" + b32("sha1"), "WARC-Block-Digest: sha1:" + b32("sha1", b"x"))]
    for r in bad:
        a, gap, b = warc.salvage(good[0] + r + good[1])
        assert (a.problem, b.problem, gap.offset, gap.length) == (None, None, len(good[0]), len(r)) and "digest" in gap.problem
    assert warc._row("f", next(warc.salvage(good[13])))[8] == hashlib.sha1(p).hexdigest()
    assert warc._row("f", next(warc.salvage(good[3])))[8] == hashlib.sha1(p).hexdigest()

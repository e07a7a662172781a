"""WARC archives of web pages: a writer, and a reader that salvages damaged files.

The writer makes uncompressed WARC/1.1 files with Spark's text writer: each row is
a record, and the line separator of the writer is the blank lines that end one.
The reader takes files of plain or gzip-compressed records. If a record fails a
check (version line, header, length, digest, terminator, member checksum), it
searches for the next offset at which a valid record begins, and logs the bytes
between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.storage import new_path, stored

END = "\r\n\r\n"
#: Payloads of fewer bytes are always stored again.
LEAST_BYTES = 100
#: Repeated payloads (about 100 bytes each) so many at most are broadcast.
BROADCAST_ROWS = 200_000
#: Payload bytes in a file at most (one larger payload has a file of its own), so that a file can be read at once.
FILE_BYTES = 1 << 26
#: Payloads of up to so many bytes share files; larger ones have files of their own.
BANDS = (1 << 12, 1 << 16, 1 << 20, 1 << 24)
#: A gzip member that inflates to more bytes is read as a stream, a record at a time.
MEMBER_BYTES = 1 << 26
#: Bytes of content that a stream is read ahead by.
AHEAD = 1 << 22
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
START = re.compile(rb"WARC/1\.[01]\r\n")


def _uri(id_: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:page:"), id_.cast("string"), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(value, size): the WARC record of each page, without the blank lines that end it, and its payload's bytes.

    Of pages with equal payloads of ``least`` bytes or more, those with the
    smallest id hold the payload and the others refer to it; a null id is never
    the smallest, and if all are null, or ids are repeated, each of these holds
    it. A null payload is empty and a null url is left out.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    big = F.col("size") >= least
    firsts = rows.where(big).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = stored(firsts, "warc-repeated")
    if firsts.count() <= BROADCAST_ROWS:  # payloads stay where they are; beyond it, a shuffle join
        firsts = F.broadcast(firsts)
    rows = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    # bytes that may not stand in a header line are percent-encoded
    target = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    only = lambda c: F.when(revisit, c)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(_uri(F.col("id")), F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws("|", "url", "digest"), 256), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        line("WARC-Refers-To", only(_uri(F.col("first")))),
        line("WARC-Profile", only(F.lit(PROFILE))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"), "size")


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, bands: tuple[int, ...] = BANDS, **columns: str) -> None:
    """Write the records of ``pages`` as WARC files of at most ``file_bytes`` of payload below ``path``.

    Each band of payload sizes is written by itself, with as many records in a file
    as fit if all are the largest of the band; bands without a page are left out.
    """
    size = F.octet_length(F.coalesce(F.col(columns.get("html_col", "html")), F.lit("")))
    band = reduce(lambda c, k: c.when(size <= bands[k], k), range(1, len(bands)), F.when(size <= bands[0], 0)).otherwise(len(bands))
    found = sorted(r[0] for r in pages.select(band.alias("band")).distinct().collect())  # a row for each band
    rows = records(pages, **columns)
    for k in found or [0]:
        low, high = (bands[k - 1] if k else -1), (bands[k] if k < len(bands) else None)
        some = rows.where((F.col("size") > low) & (F.lit(True) if high is None else F.col("size") <= high))
        each = max(1, file_bytes // high) if high else 1
        some.select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", each).text(path)


def _digest_holds(want: str | None, data: bytes) -> bool:
    """Whether a labelled digest (hex or base 32, as both are in use) is that of the data; unknown ones are not checked."""
    if not want or ":" not in want:
        return True
    name, value = want.split(":", 1)
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return True
    digest = hashlib.new(name, data)
    return value.strip().lower() == digest.hexdigest() or value.strip().upper().rstrip("=") == base64.b32encode(digest.digest()).decode().rstrip("=")


def parse_record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """(end, headers with lower-case names, block) of the record at an offset; ValueError names the failed check."""
    if not (m := START.match(data, at)):
        raise ValueError("no version line")
    until = data.find(b"\r\n\r\n", m.end() - 2)
    if until < 0:
        raise ValueError("header without end")
    head: dict[str, str] = {}
    for line in data[m.end() : until].split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("broken header line")
        head[name.strip().lower()] = value.strip()
    if not {"warc-type", "warc-record-id"} <= head.keys():
        raise ValueError("required header missing")
    size = head.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise ValueError("no length")
    begin, end = until + 4, until + 4 + int(size)
    block = data[begin:end]
    if len(block) < int(size):
        raise ValueError("truncated")
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no terminator")
    if not _digest_holds(head.get("warc-block-digest"), block):
        raise ValueError("block digest")
    if "http" in head.get("content-type", "") and head.get("warc-type") == "response" and not _digest_holds(head.get("warc-payload-digest"), block.partition(b"\r\n\r\n")[2]):
        raise ValueError("payload digest")
    return end + 4, head, block


def inflate(data: bytes, at: int) -> tuple[int, bytes | None, str]:
    """(end, content, "") of the gzip member at an offset; of one that the file's end cuts off what it still yields, and why it failed.

    The content is None if it is larger than ``MEMBER_BYTES``.
    """
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(memoryview(data)[at:], MEMBER_BYTES)
        if d.eof or len(out) < MEMBER_BYTES:
            return len(data) - len(d.unused_data), out, "" if d.eof else "gzip: truncated"
        while not d.eof and d.decompress(d.unconsumed_tail, AHEAD):  # its end and its checksum, nothing kept
            pass
    except zlib.error as e:
        return at, b"", f"gzip: {e}"
    return len(data) - len(d.unused_data), None, "" if d.eof else "gzip: truncated"


class _Content:
    """The content of a large gzip member as a window that moves on; ``size`` is that of the whole content."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.size = data, at, 0
        d = zlib.decompressobj(31)
        rest: bytes | memoryview = memoryview(data)[at:]
        while not d.eof and (n := len(d.decompress(rest, AHEAD))):
            self.size += n
            rest = d.unconsumed_tail
        self.begin()

    def begin(self) -> None:
        self.d, self.rest = zlib.decompressobj(31), memoryview(self.data)[self.at :]
        self.held, self.first = b"", 0

    def upto(self, end: int) -> bool:
        """Hold the content up to an offset; whether it goes so far."""
        parts = [self.held]
        have = self.first + len(self.held)
        while have < min(end, self.size):
            part = self.d.decompress(self.rest, AHEAD)
            self.rest = self.d.unconsumed_tail
            parts.append(part)
            have += len(part)
        self.held = b"".join(parts)
        return have >= end

    def drop(self, until: int) -> None:
        """Let go of what is before an offset."""
        self.held, self.first = self.held[until - self.first :], until

    def parts(self) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
        """What ``salvage`` makes of the content, from its begin, with one record in memory."""
        self.begin()
        at, lost, reason = 0, None, ""
        while at < self.size:
            self.upto(at + AHEAD)
            self.drop(at)
            try:
                end, head, block = self._record()
            except ValueError as e:
                if lost is None:
                    lost, reason = at, str(e)
                at = self._next(at + 1)
                continue
            if lost is not None:
                yield "gap", lost, at, {}, b"", reason
                lost = None
            yield "record", at, at + end, head, block, ""
            at += end
        if lost is not None:
            yield "gap", lost, self.size, {}, b"", reason

    def _record(self) -> tuple[int, dict[str, str], bytes]:
        """The record at the window's begin, read on as far as its header says and the content goes."""
        ahead = AHEAD
        while START.match(self.held) and self.held.find(b"\r\n\r\n", 8) < 0 and self.first + len(self.held) < self.size:
            ahead *= 2
            self.upto(self.first + ahead)
        length = re.search(rb"(?i)\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", self.held[: self.held.find(b"\r\n\r\n", 8) + 4])
        if length:
            end = self.held.find(b"\r\n\r\n", 8) + 8 + int(length[1])
            if self.first + end <= self.size:
                self.upto(self.first + end)
        return parse_record(self.held, 0)

    def _next(self, at: int) -> int:
        """Where the next version line begins, or the content's end."""
        while True:
            if m := START.search(self.held, at - self.first):
                return self.first + m.start()
            have = self.first + len(self.held)
            if have >= self.size:
                return self.size
            at = max(at, have - 9)  # a line may begin in what is held
            self.drop(at)
            self.upto(have + AHEAD)


def _used(data: bytes, at: int, size: int) -> int:
    """The offset up to which a member is read for its first ``size`` bytes of content."""
    d = zlib.decompressobj(31)
    d.decompress(memoryview(data)[at:], max(size - 1, 1))  # the last byte would take the checksum along
    return len(data) - len(d.unconsumed_tail)


def salvage(data: bytes, members: bool = True) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """("record", start, end, headers, block, "") and ("gap", start, end, {}, b"", reason), covering all bytes in order.

    Offsets are those of the file; the records of one gzip member share its range.
    A gap ends where the next record or member passes every check, or at the end.
    The content of a member, and what one cut off by the file's end still yields, is searched in the
    same way: its bad parts are one gap with the member's range before its good
    records, and the reason gives their offsets in the content. A cut member
    with good records ends where the next record or member begins; one whose data or
    checksum is wrong is a gap.
    """
    at, lost, reason, zipped, plain = 0, None, "", -1, -1
    held: Callable[[], Iterable[tuple[dict[str, str], bytes]]] = tuple  # good records of a cut member, which begins at lost

    def closed(end: int) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
        yield "gap", lost, end, {}, b"", reason
        for head, block in held():
            yield "record", lost, end, head, block, ""

    while at < len(data):
        bad, search = "", at + 1
        found: Callable[[], Iterable[tuple[dict[str, str], bytes]]] = tuple
        if members and data.startswith(GZIP, at):
            end, inner, failed = inflate(data, at)
            if inner is None:  # twice through the content: what is in it, then its records one by one
                content = _Content(data, at)
                gaps, last = [], 0
                for p in content.parts():
                    if p[0] == "gap":
                        gaps.append(p)
                    else:
                        last = p[2]
                found = lambda c=content: ((p[3], p[4]) for p in c.parts() if p[0] == "record")
            else:
                parts = list(salvage(inner, False))
                gaps = [p for p in parts if p[0] == "gap"]
                last = max((p[2] for p in parts if p[0] == "record"), default=0)
                found = lambda good=[(p[3], p[4]) for p in parts if p[0] == "record"]: good
            bad = "; ".join([*filter(None, [failed]), *(f"content {p[1]}-{p[2]}: {p[5]}" for p in gaps)])
            if failed and last:
                if lost is not None:
                    yield from closed(at)
                lost, reason, held = at, bad, found
                search = max(at + 1, _used(data, at, last))
            whole = not failed and (last > 0 or not bad)
        else:
            try:
                end, head, block = parse_record(data, at)
                found, whole = (lambda one=((head, block),): one), True
            except ValueError as e:
                bad, whole = str(e), False
        if not whole:
            if lost is None:
                lost, reason, held = at, bad, tuple
            if zipped < search:
                zipped = data.find(GZIP, search) % (len(data) + 1)  # the length if there is none
            if plain < search:
                plain = m.start() if (m := START.search(data, search)) else len(data)
            at = min(zipped, plain)
            continue
        if lost is not None:
            yield from closed(at)
            lost, held = None, tuple
        if bad:
            yield "gap", at, end, {}, b"", bad
        for head, block in found():
            yield "record", at, end, head, block, ""
        at = end
    if lost is not None:
        yield from closed(len(data))


READ = (
    "file string, kind string, start long, end long, reason string, headers map<string,string>, "
    "payload_bytes long, payload_digest string, http string, block binary"
)


def payload_of(head: dict[str, str], block: bytes) -> tuple[str | None, bytes]:
    """(HTTP header or null, payload) of a record's block."""
    if "application/http" not in head.get("content-type", ""):
        return None, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return http.decode("iso-8859-1"), payload


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """file, kind (record or gap), start, end, reason, headers, and the payload's size and SHA-256, HTTP header and block.

    All that the files below ``path`` hold; without ``blocks`` these are null. Gaps are the log of quarantined bytes. An empty file has no row. One file is
    in a task's memory at a time, so files should be of bounded size, as
    ``write_archives`` makes them.
    """
    own = spark.newSession()  # so that its setting is no other query's
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a file a batch
    files = own.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(
            [
                ("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
                ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("http", pa.string()), ("block", pa.binary()),
            ]
        )
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows, held = [], 0
                for kind, start, end, head, block, reason in salvage(content.as_py() or b""):
                    http, payload = payload_of(head, block) if kind == "record" else (None, None)
                    told = (None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest())
                    rows.append((name.as_py(), kind, start, end, reason or None, list(head.items()), *told, http, block if blocks else None))
                    held += len(block) if blocks else 200
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    out = new_path(spark, "warc-records")
    files.select("path", "content").mapInArrow(run, READ).write.parquet(out)
    return spark.read.schema(READ).parquet(out)


def pages_read(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id): the page records among those read.

    The size and digest of a response are those of its payload as read; a revisit
    has them in its record. A record whose id is not a page's number has a null
    page_id; record_id is the id as it stands.
    """
    head = lambda name: F.try_element_at("headers", F.lit(name))
    page = lambda name: F.nullif(F.regexp_extract(F.coalesce(head(name), F.lit("")), "^<urn:page:(.*)>$", 1), F.lit("")).try_cast("long")
    rows = found.where("kind = 'record'").withColumn("type", head("warc-type")).where(F.col("type").isin("response", "revisit"))
    told = F.regexp_extract("http", r"(?im)^Content-Length: *([0-9]+)\r?$", 1).try_cast("long")
    fresh = F.col("type") == "response"
    return rows.select(
        page("warc-record-id").alias("page_id"),
        F.when(fresh, F.col("payload_bytes")).otherwise(told).alias("payload_bytes"),
        F.when(fresh, F.col("payload_digest")).otherwise(F.regexp_replace(head("warc-payload-digest"), "^sha256:", "")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
        head("warc-record-id").alias("record_id"),
    )


def op10(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from archives."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return pages_read(read_archives(pages.sparkSession, path, blocks=False)).drop("record_id")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, octet_length(b) AS payload_bytes, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""

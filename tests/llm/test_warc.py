import gzip
import hashlib
import random

from shelfspark.llm import warc


def record(k, payload=b"hello", **more):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def ids(data):
    out = list(warc.salvage(data))
    at = 0
    for kind, start, end, *_ in out:  # ranges cover the file; records of a member share theirs
        assert start == at or (kind == "record" and end == at)
        at = end
    assert at == len(data)
    return [x[3]["warc-record-id"][10:-1] for x in out if x[0] == "record"], [(x[1], x[2]) for x in out if x[0] == "gap"]


def test_salvage_plain():
    recs = [record(k, b"x" * k * 50 + b"\r\nWARC/1.1\r\nnot a record\r\n\r\n") for k in range(6)]
    assert ids(b"".join(recs)) == (list("012345"), [])
    assert ids(b"") == ([], [])
    data = bytearray(b"".join(recs))
    at, size = sum(map(len, recs[:2])), len(recs[2])
    data[at + size - 20] ^= 1  # in the block
    assert ids(bytes(data)) == (list("01345"), [(at, at + size)])
    lost = b"".join(recs[:2]) + b"garbage" + b"".join(recs[2:4]) + recs[4][:-30]
    found, gaps = ids(lost)
    assert found == list("0123") and gaps[0] == (at, at + 7) and gaps[1][1] == len(lost)


def test_salvage_gzip():
    recs = [record(k, bytes([k]) * 300) for k in range(5)]
    members = [gzip.compress(r) for r in recs]
    assert ids(b"".join(members))[0] == list("01234")
    bad = bytearray(members[1])
    bad[len(bad) // 2] ^= 0xFF
    assert ids(members[0] + bytes(bad) + b"".join(members[2:])) == (list("0234"), [(len(members[0]), len(members[0]) + len(bad))])
    assert ids(members[0] + members[1][:-9] + members[2] + recs[3])[0] == list("023")
    assert ids(gzip.compress(recs[0] + recs[1]) + recs[2])[0] == list("012")


def test_salvage_never_fails():
    r = random.Random(6)
    data = b"".join(record(k, r.randbytes(80)) if k % 2 else gzip.compress(record(k, r.randbytes(80))) for k in range(12))
    for _ in range(200):
        broken = bytearray(data)
        for _ in range(r.randrange(1, 6)):
            broken[r.randrange(len(broken))] = r.randrange(256)
        cut = r.randrange(len(broken))
        found, _ = ids(bytes(broken[:cut]) + bytes(broken[cut + r.randrange(50) :]))
        assert len(found) >= 4


def pages(spark):
    long = "long " * 40
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, long), (4, "u%20", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (None, "v", "é\r\n\r\nWARC/1.1\r\n" * 30)]
    rows += [(8, "u", "big" * 500_000), (9, "u", "twin" * 50), (9, "u", "twin" * 50)]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, kind string")


def test_op10_edges(spark):
    rows, df = pages(spark)
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = html in first and i != first[html]
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    assert sorted((tuple(r) for r in warc.op10(df).collect()), key=repr) == sorted(want, key=repr)
    assert warc.op10(df.limit(0)).count() == 0


def test_shuffle_join_beyond_the_bound(spark, monkeypatch):
    rows, df = pages(spark)
    want = sorted(map(tuple, warc.op10(df).collect()), key=repr)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, warc.op10(df).collect()), key=repr) == want


def test_damaged_archive(spark, tmp_path):
    _, df = pages(spark)
    warc.write_archives(df.coalesce(1), str(tmp_path / "w"), file_bytes=5000, bands=(1000, 1 << 20))
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) >= 2
    files.sort(key=lambda f: -f.read_bytes().count(b"WARC/1.1\r\n"))
    data = files[0].read_bytes()
    at = data.find(b"WARC/1.1", 10)
    files[0].write_bytes(data[:at] + b"\x00" * 9 + data[at:])
    (tmp_path / "w" / f".{files[0].name}.crc").unlink(missing_ok=True)
    found = warc.read_archives(spark, str(tmp_path / "w"))
    gaps = found.where("kind = 'gap'").collect()
    assert [(g.start, g.end) for g in gaps] == [(at, at + 9)] and gaps[0].reason
    assert warc.pages_read(found).count() == df.count()
    blocks = found.where("kind = 'record' AND block IS NOT NULL").count()
    assert blocks == df.count()


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(k, "http://x", chr(97 + k % 26) * (900 if k % 2 else 30_000 + k)) for k in range(40)] + [(100, None, "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), file_bytes=100_000, bands=(1000, 50_000))
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part-*"))
    assert sizes[-1] < 302_000 and sizes[-2] < 110_000 and len(sizes) <= 16
    found = warc.pages_read(warc.read_archives(spark, str(tmp_path / "w"), blocks=False))
    assert sorted((r.page_id, r.payload_bytes) for r in found.collect()) == [(i, len(h)) for i, _, h in rows]


def test_ids_that_are_no_numbers(spark, tmp_path):
    df = spark.createDataFrame([("a1", "u", "x" * 200), ("b2", "u", "x" * 200), ("7", "u", "y")], "page_id string, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    found = warc.pages_read(warc.read_archives(spark, str(tmp_path / "w")))
    got = sorted((r.record_id, r.page_id, r.record_type) for r in found.collect())
    assert got == [("<urn:page:7>", 7, "response"), ("<urn:page:a1>", None, "response"), ("<urn:page:b2>", None, "revisit")]


def test_member_of_any_size(monkeypatch):
    """Members read as a stream give what those read at once give, whatever is wrong with them."""
    r = random.Random(3)
    recs = [record(k, r.randbytes(r.choice([0, 30, 400, 5000]))) for k in range(12)]
    bad = bytearray(recs[4])
    bad[-9] ^= 1
    huge = recs[5].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    contents = [b"".join(recs), b"junk" + b"".join(recs), b"".join([*recs[:4], bytes(bad), *recs[5:]]), b"".join([*recs[:5], huge, *recs[6:], b"WARC/1.1\r\nWARC-Type: x"]), b"no record at all " * 90, r.randbytes(3000) + recs[7] + b"WARC/1."]
    files = [gzip.compress(c, level) for c in contents for level in (0, 6)]
    files += [f[:-k] for f in files for k in (3, 8, 300) if len(f) > 400]
    flipped = []
    for f in files[:6]:
        f = bytearray(f)
        f[len(f) // 2] ^= 64
        flipped.append(bytes(f))
    files = [x + recs[0] + y for x, y in zip(files + flipped, [*files[1:], *flipped, files[0]])]
    want = [list(warc.salvage(f)) for f in files]
    for ahead in (16, 700):
        monkeypatch.setattr(warc, "MEMBER_BYTES", 1)
        monkeypatch.setattr(warc, "AHEAD", ahead)
        assert [list(warc.salvage(f)) for f in files] == want
    assert sum(x[0] == "record" for w in want for x in w) > 200


def test_salvage_inside_gzip_members():
    recs = [record(k, random.Random(k).randbytes(400)) for k in range(5)]
    bad = bytearray(recs[2])
    bad[-40] ^= 1
    one = gzip.compress(b"".join([*recs[:2], bytes(bad), *recs[3:]]))  # its checksum holds
    assert ids(one + recs[0]) == (list("01340"), [(0, len(one))])
    at = sum(map(len, recs[:2]))
    assert [x[5] for x in warc.salvage(one) if x[0] == "gap"] == [f"content {at}-{at + len(bad)}: block digest"]
    for level in (0, 6):  # cut off in the last record; level 0 keeps the records readable in the file
        cut = gzip.compress(b"".join(recs), level)[:-200]
        assert ids(recs[4] + cut) == (list("40123"), [(len(recs[4]), len(recs[4]) + len(cut))])

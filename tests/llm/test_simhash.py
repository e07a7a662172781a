import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import simhash


def brute_fp(text):
    b = (text or "").encode()
    words, now = [], b""
    for c in b:
        if c == 0x20 or 9 <= c <= 13:
            words, now = (words + [now] if now else words), b""
        else:
            now += bytes([c + 32 if 65 <= c <= 90 else c])
    words += [now] if now else []
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g, 42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 or (ids[i] == ids[j] and ids[i] is not None):
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            r = find(i)
            out[r] = min(out.get(r, ids[i]), ids[i])
    return [out.get(find(i)) for i in range(len(ids))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB \t\n\x0b Éxy"), max_size=40) | st.none())
def test_fingerprint(text):
    assert simhash.simhash(text) == brute_fp(text)


def test_long_text():
    text = " ".join(f"w{i % 977}" for i in range(simhash.CHUNK + 5000))
    ones = simhash.simhash(text)
    old, simhash.CHUNK = simhash.CHUNK, 999
    try:
        assert simhash.simhash(text) == ones
    finally:
        simhash.CHUNK = old


def check_links(spark, fps, dense):
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "node long, fp long")
    edges = [(r.src, r.dst) for r in simhash.hamming_links(df, dense).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in edges) or dense < 64
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[find(a)] = find(b)
    got, want = [find(i) for i in range(len(fps))], brute_components(list(range(len(fps))), fps)
    pairs = {}
    assert all(pairs.setdefault(g, w) == w for g, w in zip(got, want)) and len(pairs) == len(set(want))


def test_links_lose_none(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(60):
        f = r.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            f ^= sum(1 << r.randrange(64) for _ in range(r.randrange(1, 4)))
    fps = sorted(x & (1 << 64) - 1 for x in fps)
    check_links(spark, fps, 64)
    check_links(spark, fps, 2)  # nearly every bucket is dense


def test_op5_edges(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text), (3, text), (3, "other words in here entirely"), (None, None), (9, ""), (8, " \n"), (None, text), (2, "x" * 3_000_000), (1, "a b"), (1, "a b")]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, node int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.op5(docs).collect()))
    ids, fps = [a for a, _ in rows], [brute_fp(b) if len(b or "") < 1000 else simhash.simhash(b) for _, b in rows]
    want = sorted((i is None, i or 0, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps)))
    assert got == want
    assert simhash.op5(docs.limit(0)).count() == 0


def test_only_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert simhash.op5(docs).first().component_id is None


def test_op5_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5(docs).collect()} == want

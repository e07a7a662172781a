import hashlib
import random
import re

from shelfspark.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = split(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, items = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def data():
    r = random.Random(3)
    vocabulary = ["the", "of", "Und", "é", "x1", "rare", "word", "Ω", "a", "b", "c"]
    bench = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 10, 14, 30])))) for k in range(12)]
    bench += [(20, None), (21, "..."), (22, bench[3][1]), (None, bench[5][1]), (5, bench[6][1])]
    docs = []
    for k in range(120):
        parts = [" ".join(r.choice([*vocabulary, "other", "z"]) for _ in range(r.randrange(30)))]
        if k % 3 == 0:
            parts.insert(r.randrange(2), r.choice(bench)[1] or "")
        docs.append((k, "; ".join(parts)))
    return [*docs, (None, bench[1][1]), (7, bench[2][1]), (7, bench[2][1]), (200, None), (201, ""), (202, "the of " * 100_000)], bench


def test_op4_and_blocks(spark):
    docs, bench = data()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, segment int, items string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    assert sorted((tuple(r) for r in d.op4(df, b).collect()), key=repr) == want
    several = d._digest(d.contamination(df, b, block_words=40)).collect()
    assert sorted(((*tuple(r), r.n_hit > 0) for r in several), key=repr) == want
    assert d.op4(df.limit(0), b).count() == 0
    assert not d.op4(df, b.limit(0)).where("contaminated").count()
    clean = {r.doc_id for r in d.clean(df, b).collect()}
    assert clean == {w[0] for w in want if not w[5]} and d.clean(df, b).columns == df.columns


def test_small_segments(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    (block,) = d.blocks(bench)
    index = d.build_index(docs, block, segment_words=500)
    hits = d.search(index, block)
    assert hits.agg({"n_hit": "sum"}).first()[0] == sum(w[2] for w in want)
    assert sum(w[2] for w in want) > 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "one two three two")], "item_id long, text string")
    rows = [(1, "one two three two"), (2, "two x one two y three"), (3, "one two three"), (4, "two one x y z three two"), (5, "x one x two x three x two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.id: r.spans for r in d.contamination(docs, bench, slop=2).collect()}
    assert {k for k, s in near.items() if s} == {1, 2}
    assert near[2] == [[0, 6]]
    assert {r.id for r in d.contamination(docs, bench, slop=3).collect() if r.spans} == {1, 2, 4, 5}
    assert {r.id for r in d.contamination(docs, bench).collect() if r.spans} == {1}

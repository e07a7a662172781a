import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from shelfspark.llm import packing, tokens

LIBRARY = Tokenizer.from_file(tokens.vocabulary_path())


def test_cut():
    for n in range(1, 10_000):
        pieces = packing.cut(n)
        assert sum(size for size, _ in pieces) == n
        assert all(k == packing.CAPACITY // size and (size == packing.CAPACITY // k or size < packing.TAIL) for size, k in pieces)
        assert all(k * size <= packing.CAPACITY for size, k in pieces)


def check(docs, pieces, most_padding):
    want = defaultdict(int)
    for i, text in docs:
        want[i, tuple([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    bins, by_id = defaultdict(list), defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
        by_id[p.doc_id].append(p)
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    for (i, ids), n in want.items():
        # each cut of this text is there as often as the text
        at = 0
        for size, _ in packing.cut(len(ids)):
            crc = zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())
            same = [p for p in by_id[i] if (p.start, p.length, p.ids_crc32, p.doc_tokens) == (at, size, crc, len(ids))]
            assert len(same) >= n
            at += size
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    padding = sum(2048 - sum(n for _, n in rows) for rows in bins.values())
    assert padding <= most_padding


def test_edges(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "x"), (5, "word " * 300_000), (6, "same"), (6, "same"), (6, "other")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k int")
    check(rows, packing.op7(docs).collect(), 2048)
    assert packing.op7(docs.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], packing.op7(docs).collect(), 3000)


def test_many_copies_fill_bins(spark):
    rows = [(k, "tiny") for k in range(5000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=7).withColumnRenamed("id", "doc_id").collect()
    check(rows, pieces, 2048)

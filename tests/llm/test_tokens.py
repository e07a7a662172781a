import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfspark.llm import tokens

PATH = tokens.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from([*map(chr, range(0x260)), *" '\n\tsdmtlverL1", "中", "😀"]), max_size=30))
def test_ids_equal_the_librarys(text):
    assert tokens.encoder(PATH).ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_special_strings_and_forgetting():
    enc = tokens.Encoder(PATH)
    for text in ("a<|endoftext|>b", " <|endoftext|> ", "", "<|endoftext"):
        assert enc.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    old, tokens.REMEMBERED = tokens.REMEMBERED, 3
    try:
        r = random.Random(2)
        for _ in range(50):
            text = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "x1", "y"]) for _ in range(6))
            assert enc.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    finally:
        tokens.REMEMBERED = old


def test_cache(spark, tmp_path):
    rows = [(1, "one two"), (2, "one two"), (None, None), (3, ""), (4, "é" * 50_000), (4, "again"), (4, "again")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, digest int, n_tokens string")
    where = str(tmp_path / "cache")
    got = tokens.token_counts(docs, cache=where).collect()
    want = sorted((i or -1, len((t or "").encode()), count(t)) for i, t in rows)
    assert sorted((r.id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert spark.read.parquet(where).count() == 4
    more = docs.unionByName(spark.createDataFrame([(9, "new text", 1, "z")], docs.schema))
    assert tokens.token_counts(more, cache=where).count() == 8
    assert spark.read.parquet(where).count() == 5  # only the miss was encoded
    marked = spark.read.parquet(where).select("digest", "version", (tokens.F.col("n_tokens") + 100).alias("n_tokens"))
    marked.write.parquet(str(tmp_path / "marked"))
    again = tokens.token_counts(docs, cache=str(tmp_path / "marked")).collect()
    assert sorted((r.id or -1, r.n_tokens - 100) for r in again) == [(i, n) for i, _, n in want]  # read, not encoded
    assert tokens.op3(docs.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: (len(r.text.encode()), n := count(r.text), n > 512) for r in docs.collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.op3(docs).collect()} == want

import random
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from shelfspark.llm import substring_dedup as s
from tests.conftest import SF

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, window, **how):
    df = s.dedup_substrings(spark.createDataFrame([(i, t, "kept") for i, t in rows], SCHEMA), window, **how)
    return sorted((tuple(r) for r in df.select("doc_id", "n_words__", "n_removed__", "kept_sha256__").collect()), key=repr)


def texts(seed, docs=60, words="abcd"):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 80)))) for i in range(docs)]
    passage = " ".join(rng.choice("mnopqrst") for _ in range(30))
    return rows + [(docs + i, f"{i} {passage}\n\tend {i}") for i in range(25)]


@pytest.mark.parametrize("window", [1, 2, 5, 12, 35])
@pytest.mark.parametrize("most_slots", [s.MOST_SLOTS, 1])
def test_same_as_brute_force(spark, window, most_slots):
    """With a sketch that is sent to the tasks, and with one that stays a table."""
    rows = texts(window)
    assert run(spark, rows, window, most_slots=most_slots) == brute(rows, window)


@pytest.mark.parametrize("most_slots", [s.MOST_SLOTS, 1])
@pytest.mark.parametrize("most_hot", [s.MOST_HOT, 0])
def test_hot_strips(spark, monkeypatch, most_slots, most_hot):
    monkeypatch.setattr(s, "HOT", 5)
    rows = texts(9)
    assert run(spark, rows, 12, most_slots=most_slots, most_hot=most_hot) == brute(rows, 12)


def test_members():
    m = s._Members(np.array([5, 5, -3, 9]), np.array([2, 1, 7, 0], np.int32))
    assert m.hold(np.array([5, 5, 5, -3, 9, 10, -9]), np.array([1, 2, 3, 7, 1, 0, 7], np.int32)).tolist() == [True, True, False, True, False, False, False]


def test_repeated_within_one_document_and_periodic(spark):
    rows = [(1, "a " * 50), (2, "a b " * 30), (3, " ".join(map(str, range(40)))), (4, "x " + " ".join(map(str, range(40))) + " y"), (5, None), (6, ""), (7, " \x0b\x0c ")]
    assert run(spark, rows, 10) == brute(rows, 10)
    assert run(spark, [], 10) == [] and run(spark, [(1, None)], 10) == brute([(1, None)], 10)


def test_rows_without_an_id_of_their_own(spark):
    rows = [(None, "u v w x y z"), (None, "u v w x y z"), (3, "u v w x y q"), (3, "only this one here and now"), (3, None)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_texts_and_other_columns(spark):
    same = "one two three four five"
    df = s.dedup_substrings(spark.createDataFrame([(1, f" A {same}\nB ", "x"), (2, same, "y"), (3, " C  D ", "z"), (4, None, None)], SCHEMA), 5)
    assert sorted((r.doc_id, r.text, r.n_words) for r in df.collect()) == [(1, "A B", "x"), (2, "", "y"), (3, " C  D ", "z"), (4, None, None)]
    with pytest.raises(ValueError):
        s.dedup_substrings(df.withColumnRenamed("n_words__", "num__"), 5)


def test_estimates_lose_nothing():
    """Equal windows select equal strips at equal offsets."""
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
    c = s.Chunk([0, 1], [200, 200], np.concatenate([w[:200], w[100:300]]), 12)
    chosen = {}
    for i in range(len(c.at)):
        chosen.setdefault(tuple(c.hashes[c.at[i] : c.at[i] + 12]), set()).add(int(c.strip[c.which[i]]))
    assert all(len(x) == 1 for x in chosen.values()) and len(c.at) == 2 * 189


def test_whole_table(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, s.op13(spark.read.parquet(f"{SF}/documents.parquet")).collect()))
    assert got == sorted(c.execute(s.OP13_SQL).fetchall())

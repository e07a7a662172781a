import random
import time

import numpy as np
import pytest

import corpus_pipeline
from shelfspark.llm import shingle_dedup, simhash


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """Least id of each id's component at Jaccard 0.8, every pair compared."""
    parent = {i: i for i, _ in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, grams(t)) for i, t in docs]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in docs}


def family(r, size, words, edits):
    """Texts each made from an earlier one by a few edits, so that similarities lie around 0.8."""
    texts = [[f"w{r.randrange(5000)}" for _ in range(words)]]
    while len(texts) < size:
        t = list(r.choice(texts))
        for _ in range(r.randrange(edits + 1)):
            at = r.randrange(len(t))
            t[at : at + r.randrange(2)] = [f"e{r.randrange(9000)}"] * r.randrange(2)
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("dense", [16, 2])
def test_against_brute_force(spark, dense):
    r = random.Random(8)
    line = " ".join(f"common{k}" for k in range(14))
    texts = [x for _ in range(12) for x in family(r, 9, r.randrange(30, 120), 4)]
    texts += [f"{x} {line}" for x in family(r, 40, 70, 3)] + [f"{line} own{k} and other{k} words{k} here{k} too{k}" for k in range(90)]
    texts += ["a b c", "A  b\nc", "a b d", "", " ", None, line, line.upper()]
    texts += [" ".join(f"x{k}" for k in range(at, at + 40)) for at in range(0, 60, 2)]  # a chain: 34 of 38 shingles shared with the next
    docs = list(enumerate(texts))
    r.shuffle(docs)
    want = brute(docs)
    assert 20 < len(set(want.values())) < len(docs) - 60
    got = shingle_dedup.near_duplicates(spark.createDataFrame(docs, "id long, text string"), dense)
    assert {x.id: x.component for x in got.collect()} == want


def test_stage_links_at_four_fifths(spark):
    words = [f"w{k}" for k in range(104)]
    near, far = list(words), list(words)
    near[30] = near[70] = "new"  # 90 of 110 shingles are shared
    far[10] = far[50] = far[90] = "new"  # 85 of 115, and a word more
    rows = [(1, " ".join(words)), (2, " ".join(near)), (5, " ".join(far[:20] + ["x"] + far[20:]))]
    assert (simhash.simhash(rows[0][1]) ^ simhash.simhash(rows[1][1])).bit_count() > simhash.TAU
    docs = spark.createDataFrame([*rows, (None, "own text"), (None, "own text")], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x.doc_id or 0 for x in kept.collect()) == [0, 1, 5]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_simhash_links_what_is_close(spark, monkeypatch):
    words = " ".join(f"w{k}" for k in range(2000))
    docs = spark.createDataFrame([(1, words), (2, words + " new"), (3, "other words of its own")], "id long, text string")
    fps = [simhash.fingerprint(shingle_dedup.shingles(shingle_dedup._words(r.text)).view("uint64")) for r in docs.collect()]
    assert 0 < (fps[0] ^ fps[1]).bit_count() <= simhash.TAU < (fps[0] ^ fps[2]).bit_count()
    none = spark.createDataFrame([], "src long, dst long")
    monkeypatch.setattr(shingle_dedup, "_pairs", lambda *_: none)  # so only SimHash finds candidates
    assert {r.id: r.component for r in shingle_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_stage_does_not_shuffle_what_stays(spark, tmp_path):
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(40)]
    rows = [*enumerate(texts), (50, texts[3]), (51, None), (52, ""), (None, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted((x.doc_id is not None, x.doc_id or 0) for x in kept.collect()) == [(False, 0)] + [(True, k) for k in [*range(5), *range(6, 40), 51]]
    twice = corpus_pipeline.near_duplicates(spark, docs.union(docs), "")
    assert sorted(map(str, twice.collect())) == sorted(map(str, kept.collect()))


def test_many_usual_keys_cost_a_text_little(spark):
    """a text's shingles are looked up in the keys that are put last; these are not sorted again for each text."""
    docs = spark.range(3000).selectExpr("id", "array_join(transform(sequence(0, 40), k -> concat('w', k, 'x', id % 50)), ' ') AS text")
    sets = {r.id: shingle_dedup.shingles(shingle_dedup._words(r.text)) for r in docs.where("id < 50").collect()}
    own = np.concatenate([x[::3] for x in sets.values()])
    usual = np.unique(np.concatenate([own, np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, shingle_dedup.USUAL - len(own))]))
    began = time.time()
    rows = shingle_dedup._sets(docs, usual).collect()
    took = time.time() - began
    for r in rows:
        x = sets[r.id % 50].tolist()
        assert r["keys"] == sorted(x, key=lambda k: k in x[::3])[: len(x) // 5 + 1]
    assert len(rows) == 3000 and took < 10  # some 30 ms a text before

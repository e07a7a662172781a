import random
import re

import pytest

from shelfspark.llm import line_dedup

BLANK = " \t\n\x0b\f\r"


def brute(docs, min_words):
    """Kept text by row: every window of every document against all earlier ones."""
    order = sorted({(d is not None, d or 0, t) for d, t in docs if t is not None})
    seen, kept = set(), {}
    for key in order:
        tokens = re.findall(f"[{BLANK}]*[^{BLANK}]+", key[2])
        words = [x.strip(BLANK) for x in tokens]
        dead = set()
        for s in range(len(words) - min_words + 1):
            w = tuple(words[s : s + min_words])
            if w in seen:
                dead.update(range(s, s + min_words))
            seen.add(w)
        out = ""
        for k, x in enumerate(tokens):
            if k in dead:
                continue
            if k and k - 1 in dead:
                first = k - 1
                while first and first - 1 in dead:
                    first -= 1
                lead, before = (y[: len(y) - len(y.lstrip(BLANK))] for y in (x, tokens[first]))
                x = ("" if first == 0 else before if "\n" in before else lead) + words[k]
            out += x
        if not dead:
            out = key[2]
        elif len(tokens) - 1 not in dead:
            out += key[2][len(key[2].rstrip(BLANK)) :]
        kept[key] = out
    return sorted(((d is None, d or 0, None if t is None else kept[d is not None, d or 0, t]) for d, t in docs), key=repr)


def rows_of(df):
    return sorted(((x.doc_id is None, x.doc_id or 0, x.text) for x in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    words = ["a", "b", "cc", "d.", "e", "f!"][: 3 + 2 * seed]
    passages = [[r.choice(words) + str(r.randrange(9)) for _ in range(r.randrange(6, 20))] for _ in range(4)]
    docs = []
    for d in range(60):
        out = []
        for _ in range(r.randrange(0, 6)):
            p = r.choice(passages)
            a = r.randrange(0, 4)
            out += p[a : len(p) - r.randrange(0, 4)] if r.random() < 0.5 else [r.choice(words)] * r.randrange(1, 12)
        docs.append((d * 3 - 5, r.choice(["", " ", "\n"]) + "".join(w + r.choice([" ", "\n", "  ", " \n\t"]) for w in out)))
    docs += [(900, None), (901, ""), (902, "one line"), (903, " \n ")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, first int, fp int")
    got = line_dedup.dedup_lines(df, min_words=6)
    assert got.columns == [*df.columns, "runs__"]
    assert rows_of(got) == brute(docs, 6)
    # ids that are not distinct numbers: null, repeated rows
    docs = [*docs, docs[3], docs[3], (None, docs[7][1]), (None, None)]
    assert rows_of(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=6)) == brute(docs, 6)
    named = [(None if i is None else f"{i + 1000:05d}", t) for i, t in docs]
    got = line_dedup.dedup_lines(spark.createDataFrame(named, "doc_id string, text string"), min_words=6).collect()
    want = brute(docs, 6)
    assert sorted(((x.doc_id is None, int(x.doc_id or 1000) - 1000, x.text) for x in got), key=repr) == want


def test_passage_and_clean_text(spark):
    passage = "\n".join(" ".join(f"w{k}x{j}" for j in range(9)) for k in range(6))  # 54 words
    short = " ".join(f"s{j}" for j in range(40))
    rows = [(1, f"mine one\n{passage}\nend"), (2, f"{short}\nother\n\n{passage}\nlast"), (3, f"{short}\nthird")]
    rows += [(4, "word " * 200_000), (5, "word " * 200_000)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"{short}\nother\n\nlast", 3: rows[2][1], 4: "word", 5: ""}
    kept = line_dedup.deduplicated(spark.createDataFrame([*rows, (6, ""), (7, None)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.op2(empty).count() == 0
    with pytest.raises(ValueError, match="runs__"):
        line_dedup.dedup_lines(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, runs__ int"))


def test_passage_inside_longer_lines(spark):
    passage = " ".join(f"p{j}" for j in range(50))
    rows = [(1, f"Own one, {passage} own end."), (2, f"First here then {passage} no"), (3, f"Before {passage}\nAfter\n{passage}"), (4, " ".join(f"p{j}" for j in range(49)))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "First here then no", 3: "Before\nAfter", 4: rows[3][1]}


def test_native_plan(spark, sf):
    plan = line_dedup.op2(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if x in plan]

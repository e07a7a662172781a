import os
import random
import re
from collections import Counter

import duckdb

from shelfspark.llm import phrases
from tests.conftest import SF

SCHEMA = "lang string, text string, rank int"


def brute(rows, longest=4, least=3, top=2000, covered=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    gone = {(lang, p[i : i + m]) for (lang, p), a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= covered * cand[lang, p[i : i + m]]}
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in gone:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, le, r) in enumerate(sorted(x)[:top]))


def run(spark, rows, **how):
    return sorted(map(tuple, phrases.collocations(spark.createDataFrame([(x, t, 1) for x, t in rows], SCHEMA), least=3, **how).collect()))


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    words = ["an", "The", "tree", "é", "x"]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n", " "]) for _ in range(rng.randrange(0, 30)))) for _ in range(60)]
    rows += [("en", "the same piece of text, again and again")] * 40
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 20
    assert run(spark, rows, top=3) == brute(rows, top=3) and run(spark, rows, longest=2) == brute(rows, longest=2)


def test_overlaps_blanks_and_nothing(spark):
    rows = [("en", "ha ha ha ha ha"), ("en", None), (None, ""), ("en", " \t. ,\n"), ("en", "nbsp word " * 4)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [("en", None)]) == []


def test_map_of_any_size_changes_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(60))) for _ in range(30)]
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "HELD", 5)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 100)
    assert run(spark, rows) == brute(rows)


def test_spill_folder(spark):
    assert phrases.spill_folder(spark).startswith("/")


def test_counts_and_copies_are_not_broadcast(spark, monkeypatch):
    """what is multiplied from a small file is merged and not sent to every task by the driver; one row a language may be."""
    scored, plans = phrases._scored, []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(phrases, "_scored", lambda candidates, counted: plan(scored(plan(candidates), counted)))
    rows = [("en", f"the same piece of text {k % 5}, again and again") for k in range(60)]
    assert run(spark, rows) == brute(rows)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_counting_on_disk(spark, monkeypatch):
    """a task whose phrases do not fit DuckDB's memory finds a folder for what does not."""
    rows = [(phrases._prefix("en") + b"word%d" % k * 4, 1) for k in range(400_000)]
    rows = spark.createDataFrame(rows, phrases.GRAM).repartition(2)
    rows = rows.unionByName(rows).coalesce(1)
    folder = phrases.spill_folder(spark)
    monkeypatch.setattr(phrases, "spill_folder", lambda _: folder)
    monkeypatch.setattr(phrases, "MEMORY", "20MB")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = phrases.frequent_phrases(rows, 2)
        assert found.count() == 400_000 and os.path.isdir(folder) and not os.listdir(folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_whole_table(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, phrases.op12(spark.read.parquet(f"{SF}/documents.parquet")).collect()))
    assert got == sorted(c.execute(phrases.OP12_SQL).fetchall())

import zlib

import numpy as np
import pytest

from shelfspark.llm import language


def test_codewords():
    for n in (1, 2, 3, 4, 6, 9, 30):
        code = language.codewords(n)
        assert code.shape[0] == n
        if n > 1:
            far = (code[:, None] != code[None]).sum(2) + np.eye(n, dtype=int) * 999
            assert far.min() >= max(1, code.shape[1] // 5)
            assert ((code.sum(0) > 0) & (code.sum(0) < n)).all()


def naive(text):
    """The n-gram counts, character by character."""
    signs = {c for a, z in language.SIGNS for c in range(a, z + 1)}
    out, c = np.zeros(language.FEATURES, np.int64), [32]
    for x in "".join("\u03c3" if x == "\u03a3" else x.lower() for x in text) + " ":
        x = ord(x) if "a" <= x <= "z" or (ord(x) >= 0xAA and ord(x) not in signs) else 32
        if x != 32 or c[-1] != 32:
            c.append(x)
    for n in language.GRAMS:
        for k in range(len(c) - n + 1):
            h = 0
            for x in c[k : k + n]:
                h = (h * 0x100000001B3 + x) % 2**64
            if set(c[k : k + n]) != {32}:
                out[h * 0x9E3779B97F4A7C15 % 2**64 >> 50] += 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 5, 97, 1 << 18])
def test_features_of_any_chunks(monkeypatch, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    for text in ("", "a", " ", "\u00dcberm\u00e4\u00dfig lange Texte, 12   words " * 9, "\u0130stanbul e\u0301\u0301 \u039f\u03a3\u03a3\u039f\u03a3 \u00ab\u2019x\u00bb", "ab" * 60):
        assert (language.features(text) == naive(text)).all()


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    sums = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and any(map(str.isalpha, r.text or "")):
            sums[r.lang] = sums.get(r.lang, 0) + language.features(r.text)
    langs = sorted(sums)
    code = language.codewords(len(langs))
    rate = np.array([sums[x] / sums[x].sum() for x in langs])
    floor = 0.5 / np.mean([sums[x].sum() for x in langs])
    log, trust = [], []
    for b in range(code.shape[1]):
        one, zero = rate[code[:, b] == 1].mean(0) + floor, rate[code[:, b] == 0].mean(0) + floor
        log.append(np.log(one / zero))
        trust.append(((one - zero) * log[-1]).sum())
    trust = np.array(trust) / np.mean(trust)
    got = {r.doc_id: r for r in language.op8(docs).collect()}
    for r in rows:
        if not any(map(str.isalpha, r.text or "")):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        margin = [language.features(r.text) @ x / 3 for x in log]
        loss = [sum(t * np.logaddexp(0, -(2.0 * c - 1) * m) for t, c, m in zip(trust, word, margin)) / max(1, code.shape[1] / 2) for word in code]
        best = int(np.argmin(loss))
        assert got[r.doc_id].lang_pred == langs[best]
        assert got[r.doc_id].score == pytest.approx(1 / sum(np.exp(loss[best] - x) for x in loss))


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language.op8(docs).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in lang}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert language.accepted(docs).count() >= 0.99 * docs.count()


def test_training_ignores_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wrong = docs.withColumn("lang", language.F.when(language.held_out(docs), "zz").otherwise(docs.lang))
    key = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.op8(df).collect())
    assert key(docs) == key(wrong)


def test_edges(spark):
    known = [(2 * k, t, l) for k in range(40) for t, l in [("der die das und nicht", "de"), ("the of and with this", "en")]]
    odd = [(1001, None, "en"), (1002, "123 $$$", "de"), (1003, "", None), (None, "the and", None), (1004, "the of " * 100_000, None), (1005, "und die", None), (1005, "und die", None)]
    df = spark.createDataFrame([(*r, 5, "x") for r in known + odd], "doc_id long, text string, lang string, score int, row__ string")
    rows = [r for r in language.op8(df).collect() if r.doc_id is None or r.doc_id > 1000]
    assert sorted((r.doc_id or 0, r.lang_pred) for r in rows) == [(0, "en"), (1001, "und"), (1002, "und"), (1003, "und"), (1004, "en"), (1005, "de"), (1005, "de")]
    assert language.accepted(df).columns == df.columns
    assert language.accepted(df).count() == len(known) + len(odd) - 3
    assert language.op8(df.limit(0)).count() == 0
    none = language.op8(df.withColumn("lang", language.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_many_languages(spark):
    rows = [(chr(0x4E00 + k) * 20, f"l{k:04d}") for k in range(700)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 700
    hit = sum(model.languages[language.decode(model, language.features(t))[0]] == lang for t, lang in rows)
    assert hit > 0.9 * len(rows)


def test_ties_do_not_depend_on_the_number_of_languages():
    """A best codeword well ahead of many equal others is no tie, though its softmax is low."""
    names = [f"l{k:02d}" for k in range(30)]
    counts = []
    for k in range(len(names)):
        own = np.zeros(language.FEATURES)
        own[:50], own[100 + k * 20 : 120 + k * 20] = 10, 3
        counts.append((names[k], own))
    model = language.fit(names, iter(counts))
    text = np.zeros(language.FEATURES, np.int64)
    text[100] = 1
    best, score, tied = language.decode(model, text, language.TIE)
    assert best == 0 and score < 0.9 and not tied
    assert language.decode(model, text * 0, language.TIE)[2]

import corpus_pipeline
from shelfspark.llm import language
from tests.llm import test_decontaminate, test_line_dedup, test_packing, test_shingle_dedup


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash", "decontaminate", "packing"]
    step = [f for _, f in corpus_pipeline.STAGES]
    now = step[0](spark, docs, sf)
    assert now.columns == docs.columns
    kept = {r.doc_id: r.text for r in now.collect()}
    model = language.learn(docs.where(~language.held_out(docs)))
    for r in docs.collect():
        if language.has_letter(r.text):
            assert language.decode(model, language.features(r.text), language.TIE)[2] != (r.doc_id in kept)
        else:
            assert r.doc_id not in kept

    now = step[1](spark, now, sf)
    assert now.columns == docs.columns
    want = {i: t for _, i, t in test_line_dedup.brute(list(kept.items()), 50)}
    want = {i: t for i, t in want.items() if t.split() or t == kept[i]}
    kept = {r.doc_id: r.text for r in now.collect()}
    assert kept == want

    now = step[2](spark, now, sf)
    assert now.columns == docs.columns
    kept = {i: kept[i] for i, c in test_shingle_dedup.brute(list(kept.items())).items() if i == c}
    assert {r.doc_id: r.text for r in now.collect()} == kept

    now = step[3](spark, now, sf)
    assert now.columns == docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {w[0] for w in test_decontaminate.brute(list(kept.items()), bench) if not w[5]}
    assert 0 < len(clean) < len(kept)
    kept = {i: t for i, t in kept.items() if i in clean}
    assert {r.doc_id: r.text for r in now.collect()} == kept

    pieces = corpus_pipeline.run(spark, sf).collect()
    test_packing.check(list(kept.items()), pieces, 3000)
    assert {p.doc_id for p in pieces} == set(kept)


def test_odd_rows(spark, tmp_path, sf):
    rows = [(1, "the of and one two three", "en", "s", 1), (None, "the of and one two three", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (3, "und der die das", "de", "s", 1), (3, "und der die das", "de", "s", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((p.doc_id is None, p.doc_id or 0) for p in out if p.start == 0) == [(False, 3), (True, 0)]
    spark.createDataFrame([], names).write.parquet(str(tmp_path / "empty/documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "empty/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0

"""Keyed tables, the posting index and the log that replays."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import changelog, search_index
from shelfspark.operators.numbering import numbered
from shelfspark.plans import track_queries
from shelfspark.sources.keyed_table import KeyedTable
from shelfspark.storage import new_path, scratch, stored


def kept(spark, key=("k",), columns="k long, v string"):
    return KeyedTable(spark, new_path(spark, "test-keyed"), list(key), columns)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def state(t, version=None):
    return sorted(map(tuple, t.read(version).collect()), key=repr)


def test_empty_and_null_keys(spark):
    t = kept(spark)
    assert state(t) == [] and t.manifest() == (0, []) and t.compact() == 0
    t.vacuum()
    t.upsert(rows(spark, (None, "a"), (1, None)))
    t.upsert(rows(spark, (None, "b")))
    assert state(t) == [(1, None), (None, "b")]


def test_deltas_deletions_and_batches(spark):
    t = kept(spark)
    t.replace(rows(spark, (1, "a"), (2, "b"), (3, "c")))
    assert t.upsert(rows(spark, (2, "x"), (4, "d")), source="s", batch=7) == 2
    assert t.upsert(rows(spark, (2, "again")), source="s", batch=7) == 2 == t.upsert(rows(spark, (2, "older")), source="s", batch=6)
    t.upsert(rows(spark, (1, "gone"), (3, "z")), gone=F.col("v") == "gone", source="other", batch=1)
    assert state(t) == [(2, "x"), (3, "z"), (4, "d")] and state(t, 1) == [(1, "a"), (2, "b"), (3, "c")]
    t.compact()
    assert state(t) == [(2, "x"), (3, "z"), (4, "d")] and [p["kind"] for p in t.manifest()[1]].count("delta") == 0
    assert t.upsert(rows(spark, (2, "again")), source="s", batch=7) == t.manifest()[0]  # sources outlive a compaction
    t.vacuum()
    assert state(t) == [(2, "x"), (3, "z"), (4, "d")]
    with pytest.raises(ValueError):
        t.read(1)


def test_last_of_several_changes(spark):
    t = kept(spark)
    changes = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "only", 9)], "k long, v string, turn int")
    t.upsert(changes, order=F.col("turn"))
    assert state(t) == [(1, "new"), (2, "only")]


def test_failed_write_leaves_the_old_snapshot(spark):
    t = kept(spark)
    t.replace(rows(spark, (1, "a")))
    broken = rows(spark, (2, "b"), (3, "c")).withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    for write in (t.replace, t.upsert):
        with pytest.raises(Exception, match="lost"):
            write(broken)
        assert state(t) == [(1, "a")] and t.manifest()[0] == 1
    t.upsert(rows(spark, (2, "b")))
    assert state(t) == [(1, "a"), (2, "b")]


def test_sync_writes_what_differs(spark):
    t = kept(spark)
    t.replace(rows(spark, (1, "a"), (2, None), (3, "c")))
    found = t.sync(rows(spark, (1, "a"), (2, None), (3, "z"), (4, "n")))
    assert sorted(map(tuple, found.collect())) == [(1, "same"), (2, "same"), (3, "changed"), (4, "new")]
    assert t.sync(rows(spark, (3, "z"))).where("change = 'gone'").count() == 3 and state(t) == [(3, "z")]


def test_index_reads_ranges_only(spark):
    docs = spark.createDataFrame([(1, "Été rouge", "Re-Fix"), (2, "été", None), (3, None, "re fixed again"), (4, "", "fix re"), (5, "rougé re  -  FIXture", "x")], "id long, a string, b string")
    index = search_index.build(docs, "id", ["a", "b"], new_path(spark, "test-postings"))
    ids = lambda q: sorted(r.id for r in search_index.find(index, q).collect())
    assert ids("ete") == [1, 2] and ids("E") == [1, 2] and ids("re-fix") == [1, 3, 5] and ids("rouge re") == [1, 5]
    assert ids("--") == [] and ids("fix") == [1, 3, 4, 5] and ids("absent ete") == []
    assert [tuple(r) for r in search_index.suggest(index, "r").collect()] == [("re", 4), ("rouge", 2)]
    plan = search_index.find(index, "ete")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(token,ete)" in plan and "LessThan(token,ete" in plan
    changed = spark.createDataFrame([(2, "rouge", None), (1, None, None)], "id long, a string, b string")
    again = search_index.refreshed(index, changed, "id", ["a", "b"], new_path(spark, "test-postings"))
    assert sorted(r.id for r in search_index.find(again, "roug").collect()) == [2, 5]


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(x * 7919 % 1000,) for x in range(1000)], "x long").repartition(5)
    assert [(r.x, r.n) for r in numbered(df, ["x"], "n", 5).orderBy("x").collect()] == [(x, x + 5) for x in range(1000)]
    assert numbered(df.limit(0), ["x"], "n").count() == 0


LOG = "seq long, operation long, entity string, id long, field string, before string, after string, undone boolean, undoes long"


def test_undo_is_refused_or_replayed(spark):
    log = spark.createDataFrame([], LOG)
    new = lambda *v: spark.createDataFrame([("t", i, "f", x) for i, x in v], "entity string, id long, field string, after string")
    log = changelog.append(log, 1, new((1, "a"), (2, "b")))
    log = changelog.append(log, 2, new((2, None), (3, "c")))
    assert changelog.next_undo(log) == 2
    now = lambda x: sorted((r.id, r.value) for r in changelog.as_of(x, 1 << 62).collect())
    once, values = changelog.undo_next(log)
    assert now(once) == [(1, "a"), (2, "b")] == now(changelog.append(spark.createDataFrame([], LOG), 1, new((1, "a"), (2, "b"))))
    assert sorted((r.id, r.value) for r in values.collect()) == [(2, "b"), (3, None)]
    assert [r.seq for r in once.orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6] and sorted(r.undoes for r in once.where("operation = 3").collect()) == [2, 2]
    twice, _ = changelog.undo_next(once)
    assert now(twice) == [] and changelog.next_undo(twice) is None
    same, nothing = changelog.undo_next(twice)
    assert now(same) == [] and nothing.count() == 0
    clash = log.withColumn("undone", F.col("operation") == 2).unionByName(log.where("operation = 2 AND id = 2").withColumn("operation", F.lit(0).cast("long")).withColumn("seq", F.lit(9).cast("long")))
    refused, nothing = changelog.undo_next(clash)
    assert nothing.count() == 0 and refused.count() == clash.count()


def test_scratch_is_cleared(spark, tmp_path):
    from pathlib import Path

    here = lambda p: Path(p.removeprefix("file://")).exists()
    with scratch(spark) as outer:
        with scratch(spark) as made:
            rows = stored(spark.range(5), "scratch-test")
            kept_path = new_path(spark, "scratch-kept")
            rows.write.parquet(kept_path)
            assert here(made[0]) and len(made) == 2
            made.remove(kept_path)
            outer.remove(kept_path)
            total = rows.count()
        assert total == 5 and not here(outer[0]) and here(kept_path)
    assert spark.read.parquet(kept_path).count() == 5


def test_stored_rows_are_derived_once(spark, sf, monkeypatch):
    plans = []
    monkeypatch.setattr(track_queries.track_table.KeyedTable, "sync", lambda self, derived: plans.append(derived._jdf.queryExecution().optimizedPlan().toString()))
    track_queries._stored(spark, sf)
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_texts_are_taken_apart_once_for_the_index(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        seen.add(1)
        return f"Éta {n} common {n % 5}"

    rows = spark.range(0, 60, 1, 8).select("id", text("id").alias("a"))
    index = search_index.build(rows, "id", ["a"], new_path(spark, "test-postings"))
    assert seen.value == 60  # finding the ranges of words reads no text
    assert sorted(r.id for r in search_index.find(index, "eta comm").collect()) == list(range(60))
    search_index.refreshed(index, rows.where("id < 10"), "id", ["a"], new_path(spark, "test-postings"))
    assert seen.value == 70

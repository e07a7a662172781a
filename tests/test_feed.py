"""The change feed, restarts included, and the collection document."""

import datetime
import glob
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.sources import readers, tree_document
from shelfspark.sources.keyed_table import KeyedTable
from shelfspark.storage import new_path
from shelfspark.streaming import feed

T0 = datetime.datetime(2024, 1, 1)


def marks(spark, path, rows):
    at = [(k, T0 + datetime.timedelta(seconds=s)) for k, s in rows]
    spark.createDataFrame(at, "key long, at timestamp").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_captured(spark):
    a = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k long, v string, w int")
    b = spark.createDataFrame([(1, "a", None), (2, "b", 2), (4, "d", 1)], "k long, v string, w int")
    assert sorted(r.key for r in feed.captured(a, b, "k", ["v", "w"], F.current_timestamp()).collect()) == [2, 3, 4]
    assert sorted(r.key for r in feed.captured(a, b, "k", ["v"], F.current_timestamp()).collect()) == [3, 4]


def test_bursts_are_due_once(spark):
    path, checkpoint = new_path(spark, "marks"), new_path(spark, "marks-checkpoint")
    marks(spark, path, [(1, 0), (1, 1), (1, 2), (2, 0), (2, 10)])
    marks(spark, path, [(3, s) for s in range(0, 70, 2)])
    marks(spark, path, [(9, 500)])  # moves the watermark on
    marks(spark, path, [(9, 900)])
    out = new_path(spark, "marks-out")
    q = feed.due(stream(spark, path, "key long, at timestamp")).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
    got = sorted((r.key, r.marks) for r in spark.read.parquet(out).where("key < 9").collect())
    assert got == [(1, 3), (2, 1), (2, 1), (3, 5), (3, 30)]


def test_settling_survives_a_restart(spark):
    base = {k: k * 10 for k in range(1, 30)}
    path, checkpoint = new_path(spark, "settle"), new_path(spark, "settle-checkpoint")
    table = KeyedTable(spark, new_path(spark, "settled"), ["id"], "id long, v long")
    fail = {"on": True}

    def derive(keys):
        if fail["on"]:
            fail["on"] = False
            raise RuntimeError("lost")
        rows = spark.createDataFrame(list(base.items()), "id long, v long")
        return rows.join(keys.select(F.col("key").alias("id")), "id", "left_semi")

    def run():
        q = feed.settle(stream(spark, path, "key long"), derive, table, checkpoint, "feed", size=4)
        q.awaitTermination()

    write = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key long").coalesce(1).write.mode("append").parquet(path)
    write(*range(1, 20))
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    base[3], base[40] = 33, 400
    del base[5]
    write(3, 5, 40)
    write(25)
    run()
    want = {k: v for k, v in base.items() if k < 20 or k in (25, 40)}
    assert {r.id: r.v for r in table.read().collect()} == want


def test_a_batch_is_derived_once(spark):
    path, calls = new_path(spark, "settle-once"), []
    table = KeyedTable(spark, new_path(spark, "settled-once"), ["id"], "id long, v long")

    def derive(keys):
        calls.append(keys.rdd.getNumPartitions())
        return keys.where("key <> 7").select(F.col("key").alias("id"), (F.col("key") * 2).alias("v"))

    spark.range(30).withColumnRenamed("id", "key").coalesce(1).write.parquet(path)
    feed.settle(stream(spark, path, "key long"), derive, table, new_path(spark, "settle-once-checkpoint"), "feed", size=4).awaitTermination()
    assert calls == [8]  # not once for each page of 4 keys
    assert {r.id: r.v for r in table.read().collect()} == {k: 2 * k for k in range(30) if k != 7}


def test_a_wish_meets_one_row_of_many_files(spark, monkeypatch):
    table = KeyedTable(spark, new_path(spark, "wishes-one"), ["wish"], "wish long, artist string, acquired long")
    table.replace(spark.createDataFrame([(i, "a", None) for i in range(20)], "wish long, artist string, acquired long"))
    seen, upsert = [], KeyedTable.upsert
    # ``order`` is not given, so rows are counted as they are met, before the table takes one of a key
    monkeypatch.setattr(KeyedTable, "upsert", lambda self, rows, **k: (seen.append(joined_rows(rows)), upsert(self, rows, **k))[1])
    path = new_path(spark, "arrivals-one")
    spark.createDataFrame([(k, "a") for k in range(50)], "file long, artist string").coalesce(1).write.parquet(path)
    feed.tick_off(stream(spark, path, "file long, artist string"), table, ["artist"], new_path(spark, "arrivals-one-checkpoint"), "files").awaitTermination()
    assert [r.acquired for r in table.read().collect()] == [0] * 20
    assert seen == [False]


def joined_rows(rows):
    """Whether the plan groups what a join has made."""
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    return "Aggregate" in plan and plan.index("Aggregate") < plan.index("Join")


def test_wishes_are_ticked_off_while_files_arrive(spark):
    rng = random.Random(3)
    wishes = [(i, f"a{i % 7}", f"t{i % 5}", None) for i in range(30)]
    table = KeyedTable(spark, new_path(spark, "wishes"), ["wish"], "wish long, artist string, title string, acquired long")
    table.replace(spark.createDataFrame(wishes, "wish long, artist string, title string, acquired long"))
    path, checkpoint = new_path(spark, "arrivals"), new_path(spark, "arrivals-checkpoint")
    want, n = {}, 0
    for _ in range(3):
        files = [(n + i, f"a{rng.randrange(9)}", f"t{rng.randrange(6)}") for i in range(6)]
        n += 6
        rng.shuffle(files)
        spark.createDataFrame(files, "file long, artist string, title string").coalesce(1).write.mode("append").parquet(path)
        q = feed.tick_off(stream(spark, path, "file long, artist string, title string"), table, ["artist", "title"], checkpoint, "files", compact_after=2)
        q.awaitTermination()
        for w, a, t, _ in wishes:
            if w not in want and (met := [f for f, x, y in files if (x, y) == (a, t)]):
                want[w] = min(met)
    assert {r.wish: r.acquired for r in table.read().where("acquired IS NOT NULL").collect()} == want and table.read().count() == 30


def test_document_is_the_same_for_any_partitions(spark, tmp_path):
    tracks = spark.createDataFrame([(i, f'n"{i}<&', None if i % 3 else "g") for i in range(200)], "id long, name string, genre string")
    nodes = spark.createDataFrame([("r", None, 0, "ROOT", True), ("a", "r", 1, "A & b", True), ("b", "r", 0, "empty", True), ("c", "a", 0, "list", False), ("d", "a", 1, "none", False)], "node string, parent string, place int, name string, folder boolean")
    entries = spark.createDataFrame([("c", i, str(i)) for i in range(120)], "node string, place int, key string")
    made = []
    for n in (1, 7):
        fields = {"TrackID": F.col("id"), "Name": F.col("name"), "Genre": F.col("genre")}
        path = str(tmp_path / f"{n}.xml")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        tree_document.write_document(tree_document.document_lines(tracks.repartition(n), "id", fields, nodes.repartition(n), entries.repartition(n)), path)
        made.append(open(path, "rb").read())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made[0] == made[1] and made[0].count(b"<TRACK ") == 320 and not glob.glob(str(tmp_path / "*.part"))
    got = {r.trackid: (r.name, r.genre) for r in readers.collection_xml(spark, path).collect()}
    assert len(got) == 200 and got[0] == ('n"0<&', "g") and got[1] == ('n"1<&', None)
    found, listed = tree_document.read_tree(spark, path, 3)
    walked = {"/".join(r.path): r.folder for r in tree_document.paths(found).collect()}
    assert walked == {"": True, "empty": True, "A & b": True, "A & b/list": False, "A & b/none": False}
    assert [r.key for r in listed.orderBy("place").collect()] == [str(i) for i in range(120)]

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import names
from shelfspark.operators import changelog, conflicts, filters, linkage, queues, similar


def test_tags_that_do_not_exist_match_nothing(spark):
    rows = spark.createDataFrame([(1, ["a"], ["a", "b"]), (2, ["b"], ["a", "b"]), (3, None, ["a", "b"])], "id int, tags array<string>, known_tags array<string>")
    hits = lambda op, v: [r.id for r in rows.where(filters.rule({"combine": "all", "conditions": [{"field": "tag", "op": op, "value": v}]})).orderBy("id").collect()]
    assert (hits("has", "a"), hits("hasNot", "a"), hits("has", "zz"), hits("hasNot", "zz")) == ([1], [2, 3], [], [])
    assert [r.id for r in rows.where(filters.condition([{"kind": "tag", "tag": "b"}])).collect()] == [2]


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0], [3.0, 1.0, 2.0, 2.0, 9.0], list(range(250)), [float(k * k % 37) for k in range(301)]])
def test_cut_points_against_numpy(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
    got = {r.k: r.cut for r in similar.cut_points(rows, "v").collect()}
    want = np.percentile(values, np.arange(101))
    assert sorted(got) == list(range(101))
    assert np.allclose([got[k] for k in range(101)], want)


def test_cut_points_of_nothing(spark):
    assert similar.cut_points(spark.createDataFrame([], "v double"), "v").count() == 0


def test_append_and_undo(spark):
    log = spark.createDataFrame([(1, 1, "t", 1, "f", None, "a", False), (2, 1, "t", 2, "f", None, "b", False)], "seq long, operation int, entity string, id long, field string, before string, after string, undone boolean")
    new = spark.createDataFrame([("t", 1, "f", "a"), ("t", 2, "f", "c"), ("t", 3, "f", "d")], "entity string, id long, field string, after string")
    more = changelog.append(log, 2, new)
    assert sorted((r.seq, r.id, r.before, r.after) for r in more.where("operation = 2").collect()) == [(3, 2, "b", "c"), (4, 3, None, "d")]
    assert sorted((r.id, r.clash, r.allowed) for r in changelog.undo(more, 1).collect()) == [(1, False, False), (2, True, False)]
    assert sorted((r.id, r.value, r.allowed) for r in changelog.undo(more, 2).collect()) == [(2, "b", True), (3, None, True)]


def test_relink_by_a_common_name_is_linear(spark):
    many = spark.range(3000).select(F.col("id").alias("entry"), F.lit("").alias("path_key"), F.lit("intro").alias("title_key"), F.lit(0).cast("long").alias("total_s"))
    one = spark.createDataFrame([(9000, "", "alone", 5)], "entry long, path_key string, title_key string, total_s long")
    files = spark.createDataFrame([(1, "", "intro", 7_000_000), (2, "", "alone", 900_000)], "file long, path_key string, title_key string, duration_ms long")
    assert [tuple(r)[:3] for r in linkage.relink(many.union(one), files).collect()] == [(9000, 2, "name")]


def test_batch_rule():
    assert queues.batch_needed(None, 5) and queues.batch_needed(100, 106) and not queues.batch_needed(100, 105) and not queues.batch_needed(100, 0)


def test_names_and_keys(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(names.version_key(F.lit("Ça & l'Œuvre ＃ Ün–der"))) == "ca and loeuvre un der"
    assert one(names.version_key(F.lit("!!! "))) == "!!!"
    assert one(names.decode_entities(F.lit("&#128512;&#x41;&#0;&nbsp;&&amp;lt;"))) == "\U0001f600A&#0; &&lt;"
    assert one(names.absolute_path(F.lit("../../a"), F.lit("/b"))) is None
    assert one(names.absolute_path(F.lit("a"), F.lit(None).cast("string"))) is None
    assert one(names.mashup_parts(F.lit("x A"))) is None and one(names.mashup_parts(F.lit("A x B vs. C"))) == ["A", "B", "C"]
    assert one(conflicts.comparison_key(F.lit("Year"), F.lit("0199"))) == "n199" and one(conflicts.comparison_key(F.lit("Rating"), F.lit(None).cast("string"))) == "s0"


def test_sides_are_dealt_once_in_shares_of_the_input(spark):
    rows = spark.range(0, 400, 1, 3).selectExpr("id % 50 AS track", "IF(id % 2 = 0, 'Year', 'Rating') AS field", "element_at(array('app', 'external', 'base'), CAST(id % 3 AS INT) + 1) AS side", "concat('', 1990 + id % 7) AS value")
    found = conflicts.sides_of(rows)
    derived = spark.createDataFrame([(1, "Rating"), (1, "Rating"), (2, "Rating")], "track long, field string")
    decided = conflicts.detect(found, rows.selectExpr("track", "false AS stale"), derived)
    shares = 3 * conflicts.SHARES
    assert found.rdd.getNumPartitions() == shares and decided.rdd.getNumPartitions() == shares  # wide rows are not shuffled again
    want = {}
    for r in rows.collect():
        own = want.setdefault((r.track, r.field), {})
        own[r.side] = min(own.get(r.side, r.value), r.value)
    got = {(r.track, r.field): {n: r[n] for n in conflicts.NAMES if r[n] is not None} for r in found.collect()}
    assert got == want and decided.count() == len(want)
    split = conflicts.sides(*(rows.where(F.col("side") == n).select("track", "field", "value") for n in conflicts.NAMES))
    assert sorted(split.collect()) == sorted(found.collect())

"""Groups so large that their pairs cannot be rows: results come from sums, leasts and representatives."""

from pyspark.sql import functions as F

from shelfspark.operators import grouping, linkage, relinking, review, wishes


def most_rows(spark, monkeypatch, module, name="stored"):
    """The numbers of rows that ``module`` stores, by name."""
    seen, put = {}, getattr(module, name)

    def counted(df, what):
        out = put(df, what)
        seen[what] = max(seen.get(what, 0), out.count())
        return out

    monkeypatch.setattr(module, name, counted)
    return seen


def test_wishes_of_one_name(spark, monkeypatch):
    """300 wishes and 300 tracks of one artist and name meet once, not 90,000 times."""
    seen = most_rows(spark, monkeypatch, wishes)
    rows = spark.range(300)
    w = rows.select(F.col("id").alias("wish"), F.lit("Some One").alias("artist"), F.lit("A Song").alias("name"), F.lit(None).cast("string").alias("isrc"))
    t = rows.select((F.col("id") + 7).alias("track"), F.lit("SOME ONE").alias("artist"), F.lit("a song").alias("name"), F.lit(None).cast("string").alias("isrc"), (F.col("id") == 200).alias("library"))
    got = wishes.find(w, t).collect()
    assert len(got) == 300 and {(r.outcome, r.track, r.by_isrc) for r in got} == {("owned", 207, False)}
    assert max(seen.values()) <= 600 and seen["wish-pairs"] == 1


def test_wish_match_of_one_title(spark):
    """3,000 wishes and 3,000 tracks of one title (9 million pairs) join as one entry each."""
    rows = spark.range(3000)
    none = F.lit(None).cast("string")
    w = rows.select(F.col("id").alias("wish"), none.alias("isrc"), F.lit("a").alias("artist"), F.lit("t").alias("title"), F.when(F.col("id") % 2 == 0, "dub").alias("version"))
    t = rows.select(F.col("id").alias("track"), (F.col("id") % 3 == 0).alias("rework"), none.alias("isrc"), F.lit("a").alias("artist"), F.lit("t").alias("title"), F.when(F.col("id") % 5 != 0, "cut").alias("version"))
    found = review.wish_match(w, t)
    assert {(r.wish % 2, r.outcome, r.track) for r in found.collect()} == {(0, "otherCut", 1), (1, "owned", 0)}
    joins = found._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count("Aggregate") >= 4  # both sides are grouped before they meet


def test_relinking_of_one_name(spark, monkeypatch):
    """F8, F9: 2,000 entries and 2,000 files of one name and length are no pairs; what is alone among them is found."""
    seen = most_rows(spark, monkeypatch, relinking)
    rows = spark.range(2001)
    e = rows.select(F.col("id").alias("entry"), F.concat(F.lit("a/"), F.col("id"), F.lit("/x.mp3")).alias("path"), F.lit("t").alias("title"), F.when(F.col("id") == 2000, 90).otherwise(50).alias("total_s"))
    f = rows.select(F.col("id").alias("file"), F.concat(F.lit("b/"), F.col("id"), F.lit("/x.mp3")).alias("path"), F.when(F.col("id") == 2000, 90_900).otherwise(50_400).alias("duration_ms"), F.lit(None).cast("string").alias("audio"), F.lit(None).cast("long").alias("track"), F.array(F.lit("t")).alias("titles"))
    none = lambda schema: spark.createDataFrame([], schema)
    found = relinking.relink_steps(e, f, none("entry long, file long, audio string"), none("entry long, audio string"), none("path string, audio string, track long, duration_ms long"), none("path string, file long"))
    assert [tuple(r) for r in found.collect()] == [(2000, 2000, "filename_duration", 0.9, False)]
    assert max(seen.values()) <= 4002


def test_alone_by_key(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "d"), (5, None)], "entry long, key string")
    f = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c"), (4, "d"), (4, "e"), (5, None)], "file long, key string")
    assert sorted(map(tuple, linkage.alone_by_key(e, f).collect())) == [(1, 1), (4, 4)]


def test_decisions_on_many_holders(spark, monkeypatch):
    """two audios of 400 tracks each, called the same, are a star and two classes and not 160,000 pairs."""
    seen = most_rows(spark, monkeypatch, grouping)
    m = spark.range(800).select(F.col("id").alias("file"), F.col("id").alias("track"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("key"), F.lit(False).alias("library"))
    none = lambda schema: spark.createDataFrame([], schema)
    keys = spark.createDataFrame([("p", "q")], "key_a string, key_b string")
    empty, links, pairs = none("key_a string, key_b string"), none("track_a long, track_b long"), none("a long, b long, outcome string")
    got = lambda apart, same: {(r.unit, r.set, r.verdict) for r in grouping.plan(m, pairs, apart, same, links, 1000).collect()}
    assert got(empty, keys) == {(0, 0, "merge"), (1, 0, "merge")}
    assert got(keys, keys) == {(0, 0, "apart"), (1, 0, "apart")}
    split = m.withColumn("file", F.col("file") + 1000).withColumn("key", F.lit(None).cast("string"))
    whole = m.unionByName(split)  # a second file without audio keeps the tracks units of their own
    found = grouping.plan(whole, pairs, empty, keys, links, 10_000).collect()
    assert len(found) == 1600 and {(r.set, r.verdict) for r in found} == {(0, "wait")} and len({r.unit for r in found}) == 800
    assert max(seen.values()) <= 1600


def test_rows_of_a_file_follow_one_another(spark):
    """a merge join on seconds streams files, so that it holds the entries of a second and a result is small on disk."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.range(60).selectExpr("id AS entry", "id % 2 AS total_s")
        f = spark.range(40).selectExpr("id AS file", "id * 40 % 1600 AS duration_ms")
        rows = [tuple(r) for r in linkage.duration_join(e, f).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = [(a, b) for a in range(60) for b in range(40) if a % 2 * 1000 - 500 <= b * 40 % 1600 < a % 2 * 1000 + 1500]
    assert sorted(rows) == want and len(rows) > 1000
    assert sum(x[1] != y[1] for x, y in zip(rows, rows[1:])) < 2 * 40

"""More queries: review queues, wish lists, offers, dues and best files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import decisions, linkage, review
from shelfspark.plans.queries import query, table


@query("SELECT l_partkey AS track, bool_or(l_returnflag <> 'R') AS shown FROM lineitem GROUP BY 1")
def hidden_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("track"), F.when(F.col("l_returnflag") == "R", "returned").alias("why"))
    return review.shown_tracks(files, "track", "why")


@query("WITH l AS (SELECT o_custkey AS a, o_custkey + o_orderkey % 7 AS b, o_orderstatus AS kind FROM orders), m AS (SELECT c_custkey AS track FROM customer WHERE c_acctbal < 0) SELECT a AS track, b AS other, kind FROM l WHERE a IN (SELECT track FROM m) UNION ALL SELECT b, a, kind FROM l WHERE b IN (SELECT track FROM m)")
def links_to_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 7).alias("b"), F.col("o_orderstatus").alias("kind"))
    mine = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("track"))
    return review.links_of(links, mine, "track")


@query("WITH q AS (SELECT 'quality' AS grp, 'broken' AS kind FROM lineitem WHERE l_tax > 0.07 UNION ALL SELECT 'quality', 'better' FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT 'pairs', 'version' FROM orders WHERE o_orderstatus = 'P') SELECT grp, kind, count(*) AS n FROM q GROUP BY ROLLUP (grp, kind)")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    queues = {"broken": lines.where("l_tax > 0.07D"), "better": lines.where("l_discount > 0.09D"), "version": orders.where("o_orderstatus = 'P'")}
    return review.review_counts(queues, {"broken": "quality", "better": "quality", "version": "pairs"})


@query("SELECT DISTINCT l_partkey AS track FROM lineitem WHERE l_tax > 0.07 OR l_discount > 0.09")
def quality_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_tax > 0.07D").select(F.col("l_partkey").alias("track")).union(lines.where("l_discount > 0.09D").select("l_partkey")).distinct()


@query("SELECT c_mktsegment AS folder, count(*) AS n, min(c_name) AS first FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def missing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return review.grouped_missing(gone.withColumnRenamed("c_mktsegment", "folder"), "folder", "c_name")


@query("SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem), (SELECT max(ts) FROM events)) AS at")
def last_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest((table(spark, sf_dir, "orders"), "o_orderdate"), (table(spark, sf_dir, "lineitem"), "l_shipdate"), (table(spark, sf_dir, "events"), "ts"))


@query("SELECT count(*) AS n FROM events, (SELECT max(ts) AS now FROM events) WHERE ts >= now - INTERVAL 7 DAY AND event_type <> 'error'")
def decisions_this_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    return events.join(now).where("ts >= now - INTERVAL 7 DAYS and event_type <> 'error'").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2 AND nullif(l_returnflag, 'N') IS NOT DISTINCT FROM nullif(CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'N' END, 'N'))")
def stage_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("o_orderstatus") == "F", "A")
    files = table(spark, sf_dir, "orders").select("o_orderkey", stamp.alias("stamp"))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("version"), F.nullif("l_returnflag", F.lit("N")).alias("stamp"))
    return review.due(files, done, "o_orderkey", ["stamp"], 2)


@query(
    "WITH w AS (SELECT o_orderkey AS wish, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS isrc, 'a' || o_custkey % 50 AS artist, 't' || o_orderkey % 60 AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'dub' END AS version FROM orders), "
    "t AS (SELECT p_partkey AS track, p_size > 25 AS rework, p_partkey AS isrc, 'a' || p_partkey % 50 AS artist, 't' || p_partkey // 50 % 60 AS title, CASE WHEN p_partkey % 2 = 0 THEN 'dub' END AS version FROM part), "
    "m AS (SELECT wish, 0 AS r, track, 'owned' AS o FROM w JOIN t USING (isrc) UNION ALL SELECT wish, CASE WHEN w.version IS NOT DISTINCT FROM t.version THEN 1 WHEN NOT rework THEN 2 ELSE 3 END, track, CASE WHEN w.version IS NOT DISTINCT FROM t.version THEN 'owned' WHEN NOT rework THEN 'otherCut' ELSE 'rework' END FROM w JOIN t ON w.artist = t.artist AND w.title = t.title), "
    "b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY wish ORDER BY r, track) = 1) SELECT wish, coalesce(o, 'missing') AS outcome, track FROM w LEFT JOIN b USING (wish)"
)
def wish_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("p_partkey")
    named = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    wishes = table(spark, sf_dir, "orders").select(o.alias("wish"), F.when(o % 4 == 0, c).alias("isrc"), named("a", c % 50).alias("artist"), named("t", o % 60).alias("title"), F.when(o % 3 == 0, "dub").alias("version"))
    tracks = table(spark, sf_dir, "part").select(p.alias("track"), (F.col("p_size") > 25).alias("rework"), p.alias("isrc"), named("a", p % 50).alias("artist"), named("t", F.floor(p / 50) % 60).alias("title"), F.when(p % 2 == 0, "dub").alias("version"))
    return review.wish_match(wishes, tracks)


@query(
    "WITH a AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS t FROM lineitem WHERE l_linenumber < 4), e AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS t FROM lineitem WHERE l_linenumber > 2), b AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS t FROM lineitem WHERE l_linenumber % 2 = 0), "
    "k AS (SELECT * FROM a UNION SELECT * FROM e UNION SELECT * FROM b), s AS (SELECT p, t, (p, t) IN (SELECT (p, t) FROM a) AS a, (p, t) IN (SELECT (p, t) FROM e) AS e, (p, t) IN (SELECT (p, t) FROM b) AS b FROM k) "
    "SELECT p, t, CASE WHEN a = e THEN 'same' WHEN a <> b THEN CASE WHEN a THEN 'add there' ELSE 'remove there' END ELSE CASE WHEN e THEN 'add here' ELSE 'remove here' END END AS decision FROM s"
)
def membership_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("p"), F.col("l_partkey").alias("t"), "l_linenumber")
    return review.membership_merge(rows.where("l_linenumber < 4"), rows.where("l_linenumber > 2"), rows.where("l_linenumber % 2 = 0"), ["p", "t"])


@query("WITH f AS (SELECT o_custkey * 10 + o_orderkey % 10 AS content, min(o_orderkey) AS file FROM orders GROUP BY 1 HAVING count(*) = 1), e AS (SELECT l_partkey * 10 + l_linenumber AS content, min(l_orderkey) AS entry FROM lineitem GROUP BY 1 HAVING count(*) = 1) SELECT content::BIGINT AS content, file, entry FROM f JOIN e USING (content)")
def lone_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 10 + F.col("o_orderkey") % 10).alias("content"), F.col("o_orderkey").alias("file"))
    entries = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("content"), F.col("l_orderkey").alias("entry"))
    return review.lone_copies(files, entries, "content")


@query("SELECT CASE WHEN c_custkey % 5 = 0 THEN 'inLibrary' WHEN o_custkey IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'unconfirmed' ELSE 'toAdd' END AS kind, count(*) AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey GROUP BY 1")
def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    rows = table(spark, sf_dir, "customer").join(files, F.col("o_custkey") == F.col("c_custkey"), "left")
    kind = review.offer_kind(F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey")), F.col("o_custkey"), F.col("c_acctbal") >= 0)
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size < 5 THEN 'demo' WHEN p_size = 7 THEN 'deleted' WHEN p_size > 45 THEN 'streaming' END AS reason, count(*) AS n FROM part GROUP BY 1")
def skip_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    reason = decisions.skip_reason(F.when(size < 5, "demo").otherwise("track"), F.when(size == 7, " ").when(size > 45, "https://x").otherwise("file://x"))
    return table(spark, sf_dir, "part").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "WITH f AS (SELECT l_partkey AS track, l_orderkey * 10 + l_linenumber AS file, l_linenumber = 7 AS chosen, l_returnflag <> 'R' AS present, ['ok', 'flagged', 'truncated', 'broken'][l_suppkey % 5 + 1] AS verdict, l_linestatus = 'O' AS playable, "
    "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 15000 + l_quantity * 150 END AS cutoff, l_suppkey % 2 AS errors, l_orderkey % 3 AS format, l_orderkey % 7 AS tags, l_tax > 0.04 AS art, ['trusted', 'probable', 'no'][l_orderkey % 3 + 1] AS known, l_linenumber AS place FROM lineitem) "
    "SELECT track, count(*) OVER (PARTITION BY track) AS files, file FROM f QUALIFY row_number() OVER (PARTITION BY track ORDER BY NOT chosen, NOT present, CASE coalesce(verdict, 'unchecked') WHEN 'ok' THEN 1 WHEN 'unchecked' THEN 2 WHEN 'flagged' THEN 3 WHEN 'truncated' THEN 4 ELSE 5 END, "
    "NOT playable, -coalesce(least(floor(cutoff / 1000), 19), -1), errors, format, -tags, NOT art, CASE known WHEN 'trusted' THEN 0 WHEN 'probable' THEN 1 ELSE 2 END, place, file) = 1"
)
def best_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o, n = F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    files = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("track"),
        (o * 10 + n).alias("file"),
        (n == 7).alias("chosen"),
        (F.col("l_returnflag") != "R").alias("present"),
        pick(("ok", "flagged", "truncated", "broken"), s % 5).alias("verdict"),
        (F.col("l_linestatus") == "O").alias("playable"),
        F.when(s % 3 != 0, 15000 + F.col("l_quantity") * 150).alias("cutoff_hz"),
        (s % 2).alias("decode_errors"),
        (o % 3).alias("format_rank"),
        (o % 7).alias("tags_filled"),
        (F.col("l_tax") > 0.04).alias("has_art"),
        pick(("trusted", "probable", "no"), o % 3).alias("known"),
        n.alias("place"),
    )
    return linkage.best_record(files, "track", review.best_file_order(), ["file"])

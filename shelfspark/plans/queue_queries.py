"""Queries of review queues, change marks, summaries, learning inputs and sends, over rows built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import collect, queues
from shelfspark.plans.catalogue import TRACKS_SQL, tracks
from shelfspark.plans.queries import ALL_SQL, RULE_ALL, RULE_ANY, query, table


def _rows(spark: SparkSession, sf_dir: str, name: str, *exprs: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, name).where(where).selectExpr(*exprs)


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "lineitem", "l_orderkey * 10 + l_linenumber AS file", "l_partkey AS track", "CASE WHEN l_suppkey % 9 = 0 THEN 'extra' END AS role")


@query(
    "WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS file, l_partkey AS track FROM lineitem), p AS (SELECT o_orderkey * 10 + 1 AS x, o_orderkey * 10 + 2 AS y FROM orders WHERE o_orderstatus = 'P'), m AS (SELECT p_partkey FROM part WHERE p_size < 20) "
    "SELECT DISTINCT least(a.track, b.track) AS a, greatest(a.track, b.track) AS b FROM p JOIN c a ON a.file = x JOIN c b ON b.file = y WHERE a.track <> b.track AND (a.track IN (FROM m) OR b.track IN (FROM m))"
)
def version_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _rows(spark, sf_dir, "orders", "o_orderkey * 10 + 1 AS file_a", "o_orderkey * 10 + 2 AS file_b", where="o_orderstatus = 'P'")
    return queues.version_doubts(pairs, _copies(spark, sf_dir).select("file", "track"), _rows(spark, sf_dir, "part", "p_partkey AS track", where="p_size < 20"))


FILES = ("o_orderkey AS file", "o_custkey % 90 AS content")


@query(
    "WITH f AS (SELECT o_orderkey AS file, o_custkey % 90 AS content FROM orders), lib AS (SELECT p_partkey AS track, p_partkey * 7 % 16000 AS linked FROM part), "
    "b AS (SELECT DISTINCT l_partkey AS track, l_orderkey AS file, CASE WHEN l_suppkey % 5 = 0 THEN 'onDisk' ELSE 'rank' END AS step FROM lineitem WHERE l_linenumber = 1), d AS (SELECT c_custkey % 90 AS k, c_nationkey AS o FROM customer) "
    "SELECT b.track, b.file, b.step FROM b JOIN lib USING (track) JOIN f ON f.file = b.file LEFT JOIN f l ON l.file = lib.linked WHERE step = 'onDisk' OR NOT EXISTS (SELECT 1 FROM d WHERE d.k = l.content AND d.o = f.content)"
)
def better_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    better = _rows(spark, sf_dir, "lineitem", "l_partkey AS track", "l_orderkey AS file", "CASE WHEN l_suppkey % 5 = 0 THEN 'onDisk' ELSE 'rank' END AS step", where="l_linenumber = 1").distinct()
    library = _rows(spark, sf_dir, "part", "p_partkey AS track", "p_partkey * 7 % 16000 AS linked")
    dismissed = _rows(spark, sf_dir, "customer", "c_custkey % 90 AS linked_key", "CAST(c_nationkey AS BIGINT) AS other_key")
    return queues.better_files(better, library, _rows(spark, sf_dir, "orders", *FILES), dismissed)


@query(
    "WITH f AS (SELECT o_orderkey AS file, o_custkey % 90 AS content FROM orders WHERE o_orderstatus = 'F') SELECT DISTINCT p_partkey AS track FROM part JOIN f ON f.file = p_partkey * 7 % 16000 WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.075) AND content NOT IN (SELECT c_custkey % 90 FROM customer WHERE c_nationkey = 3)"
)
def quality_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _rows(spark, sf_dir, "orders", *FILES, where="o_orderstatus = 'F'")
    library = _rows(spark, sf_dir, "part", "p_partkey AS track", "p_partkey * 7 % 16000 AS linked")
    better = _rows(spark, sf_dir, "lineitem", "l_partkey AS track", where="l_tax > 0.075D")
    return queues.quality_queue(flagged, library, better, _rows(spark, sf_dir, "customer", "c_custkey % 90 AS content", where="c_nationkey = 3"))


@query(
    "WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS file, l_partkey AS track, l_suppkey % 9 = 0 AS extra FROM lineitem) SELECT o_orderkey * 10 + 3 AS file, track FROM orders LEFT JOIN c ON file = o_orderkey * 10 + 3 WHERE o_orderstatus = 'P' UNION SELECT file, track FROM c WHERE extra"
)
def hidden_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _rows(spark, sf_dir, "orders", "o_orderkey * 10 + 3 AS file", "CASE WHEN o_orderstatus = 'P' THEN 'removed' END AS reason")
    return queues.hidden_files(files, _copies(spark, sf_dir))


@query(
    "WITH c AS (SELECT o_custkey AS grp, o_orderkey AS track, o_orderkey % 4 AS cues, o_orderkey // 4 % 3 AS plays, o_orderkey % 7 AS rank FROM orders), "
    "w AS (SELECT *, row_number() OVER z AS n, lead(cues) OVER z AS c2, lead(plays) OVER z AS p2, lead(rank) OVER z AS r2, count(*) OVER (PARTITION BY grp) AS k FROM c WINDOW z AS (PARTITION BY grp ORDER BY cues DESC, plays DESC, rank, track)) "
    "SELECT grp, track AS keep, CASE WHEN cues <> c2 THEN 'moreCues' WHEN plays <> p2 THEN 'morePlays' WHEN rank <> r2 THEN 'betterFile' ELSE 'tied' END AS why FROM w WHERE n = 1 AND k > 1"
)
def keep_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "orders", "o_custkey AS grp", "o_orderkey AS track", "o_orderkey % 4 AS cues", "o_orderkey div 4 % 3 AS plays", "o_orderkey % 7 AS rank")
    return queues.keep_suggestion(rows, "grp")


@query(
    "WITH f AS (SELECT l_partkey AS track, l_orderkey * 10 + l_linenumber AS file, l_returnflag = 'R' AS gone, l_linestatus AS ls, l_suppkey % 2 AS errors FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1), "
    "w AS (SELECT *, lag(gone) OVER z AS g, lag(ls) OVER z AS l, lag(errors) OVER z AS e, row_number() OVER z AS n FROM f WINDOW z AS (PARTITION BY track ORDER BY gone, ls, errors, file)) "
    "SELECT track, file, CASE WHEN gone <> g THEN 'gone' WHEN ls <> l THEN 'ls' WHEN errors <> e THEN 'errors' ELSE 'file' END AS why FROM w WHERE n > 1"
)
def why_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"), F.struct("l_partkey", "l_suppkey")).alias("x"))
    rows = lines.select(F.col("x.l_partkey").alias("track"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file"), (F.col("x.l_returnflag") == "R").alias("gone"), F.col("x.l_linestatus").alias("ls"), (F.col("x.l_suppkey") % 2).alias("errors"))
    steps = ["gone", "ls", "errors", "file"]
    return queues.why_ahead(rows, "track", steps, F.struct(*steps)).select("track", "file", "why")


@query(
    "WITH c AS (SELECT l_partkey AS track, l_shipmode AS value, src FROM (SELECT l_partkey, 'v' || (l_suppkey % 4) AS l_shipmode, ['tags', 'net', 'name'][l_linenumber % 3 + 1] AS src FROM lineitem)), "
    "m AS (SELECT track, value, list_sort(list(DISTINCT src)) AS sources, min(CASE src WHEN 'tags' THEN 1 WHEN 'net' THEN 2 ELSE 3 END) AS p FROM c WHERE value <> 'v' || (track % 5) GROUP BY 1, 2) "
    "SELECT track, value, array_to_string(sources, ',') AS sources, row_number() OVER (PARTITION BY track ORDER BY len(sources) DESC, p, value) AS place FROM m"
)
def rank_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit(" v"), (F.col("l_suppkey") % 4).cast("string"))
    source = F.get(F.array(*map(F.lit, ("tags", "net", "name"))), F.col("l_linenumber") % 3)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("track"), value.alias("value"), source.alias("source"), F.concat(F.lit("v"), (F.col("l_partkey") % 5).cast("string"), F.lit(" ")).alias("current"))
    out = queues.rank_suggestions(rows, ["track"], {"tags": 1, "net": 2, "name": 3})
    return out.withColumn("sources", F.array_join("sources", ","))


@query("SELECT DISTINCT CASE event_type WHEN 'click' THEN user_id WHEN 'view' THEN event_id % 90 END AS track FROM events WHERE event_type IN ('click', 'view')")
def undo_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _rows(spark, sf_dir, "events", "event_type AS tbl", "user_id", "event_id % 90 AS row_id")
    return queues.touched(log, {"click": "user_id", "view": "row_id"})


@query(
    "WITH d AS (SELECT p_partkey FROM part UNION SELECT user_id + 100000 FROM events WHERE event_type = 'error'), t AS (SELECT p_partkey AS track FROM d ORDER BY 1 LIMIT 70) SELECT track, true AS taken FROM t UNION ALL SELECT p_partkey, false FROM d WHERE p_partkey NOT IN (SELECT track FROM t)"
)
def due_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks are added, the mark for all tracks is expanded, and a batch is taken."""
    due = queues.mark(_rows(spark, sf_dir, "events", "user_id + 100000 AS track", where="event_type = 'error'"), spark.createDataFrame([(queues.EVERY,)], "track long"))
    taken, rest = queues.take_batch(queues.expand(due, _rows(spark, sf_dir, "part", "p_partkey AS track")), 70)
    return taken.withColumn("taken", F.lit(True)).union(rest.withColumn("taken", F.lit(False)))


@query("SELECT p_partkey FROM part WHERE p_size % 3 <> p_size % 5 OR p_partkey % 10 = 0 OR p_partkey % 10 = 1")
def link_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _rows(spark, sf_dir, "part", "p_partkey", "p_size % 3 AS link", where="p_partkey % 10 <> 0")
    after = _rows(spark, sf_dir, "part", "p_partkey", "p_size % 5 AS link", where="p_partkey % 10 <> 1")
    return queues.churned(before, after, "p_partkey", "link")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS DISTINCT FROM CASE WHEN o_custkey % 2 = 0 THEN 'F' END")
def truncation_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _rows(spark, sf_dir, "orders", "o_orderkey", "CASE WHEN o_custkey % 2 = 0 THEN 'F' END AS state")
    return queues.due_again(decided, _rows(spark, sf_dir, "orders", "o_orderkey", "nullif(o_orderstatus, 'O') AS state"), "o_orderkey", "state")


@query("SELECT o_orderkey AS file, o_custkey % 10 AS folder FROM orders WHERE o_custkey % 10 <> 9 AND o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5)")
def inbox_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = _rows(spark, sf_dir, "orders", "o_orderkey AS file", "o_custkey % 10 AS folder")
    baseline = _rows(spark, sf_dir, "orders", "o_orderkey AS file", "o_custkey % 10 AS folder", where="o_orderstatus = 'F' AND o_custkey % 10 <> 9")
    return queues.arrivals(walk, baseline, _rows(spark, sf_dir, "lineitem", "l_orderkey AS file", where="l_linenumber = 5"))


@query("WITH w AS (SELECT o_orderkey AS wish, o_custkey % 40 AS a, o_orderkey % 30 AS t FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0), f AS (SELECT p_partkey AS file, p_size % 40 AS a, p_partkey % 30 AS t FROM part) SELECT wish, min(file) AS file FROM w JOIN f USING (a, t) GROUP BY 1")
def tick_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    wishes = _rows(spark, sf_dir, "orders", "o_orderkey AS wish", "o_custkey % 40 AS artist", "o_orderkey % 30 AS title", "IF(o_orderkey % 2 = 0, 'x', 'y') AS version", "nullif(o_orderstatus, 'O') AS acquired")
    files = _rows(spark, sf_dir, "part", "p_partkey AS file", "CAST(p_size % 40 AS BIGINT) AS artist", "p_partkey % 30 AS title", "'x' AS version")
    return queues.tick_off(wishes, files)


@query("WITH f AS (SELECT o_orderkey AS file, o_custkey AS content, o_orderstatus = 'F' AS present FROM orders), h AS (SELECT content, min(file) AS file FROM f WHERE present GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey AS track, h.file FROM part JOIN f ON f.file = p_partkey * 3 AND NOT f.present JOIN h USING (content)")
def moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _rows(spark, sf_dir, "orders", "o_orderkey AS file", "o_custkey AS content", "o_orderstatus = 'F' AS present")
    return queues.moved_files(_rows(spark, sf_dir, "part", "p_partkey AS track", "p_partkey * 3 AS linked"), files)


@query("SELECT o_orderkey AS file, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 100 ELSE o_custkey END AS grp FROM orders")
def regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.regroup(_rows(spark, sf_dir, "orders", "o_orderkey AS file", "o_custkey AS grp"), _rows(spark, sf_dir, "orders", "o_orderkey AS file", "o_orderkey % 100 AS grp", where="o_orderkey % 4 = 0"))


@query("SELECT user_id AS session, min(ts) AS started, count(*) AS plays, count(nullif(event_type, 'error')) AS matched FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def play_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.play_counts(_rows(spark, sf_dir, "events", "user_id AS session", "ts AS at", "nullif(event_type, 'error') AS track"))


@query("SELECT o_custkey AS list, count(*) AS items, count(*) FILTER (o_orderstatus = 'F' OR o_orderkey % 5 = 0) AS owned, count(*) FILTER (NOT (o_orderstatus = 'F' OR o_orderkey % 5 = 0)) AS missing FROM orders GROUP BY 1")
def wishlist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "orders", "o_custkey AS list", "IF(o_orderstatus = 'F', o_orderkey, NULL) AS track", "IF(o_orderkey % 5 = 0, true, NULL) AS acquired")
    return collect.wish_summary(rows)


@query("SELECT l_partkey, sum(l_discount * l_linenumber) / nullif(sum(l_linenumber), 0) AS score FROM lineitem GROUP BY 1")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.weighted_score(_rows(spark, sf_dir, "lineitem", "l_partkey", "l_discount AS score", "l_linenumber AS items"), "l_partkey")


@query("WITH b AS (SELECT l_partkey, l_returnflag AS b, to_json(list('s' || l_suppkey ORDER BY l_orderkey, l_linenumber, l_suppkey)) AS v FROM lineitem GROUP BY 1, 2) SELECT l_partkey, '{' || string_agg('\"' || b || '\":' || v, ',' ORDER BY b) || '}' AS digest FROM b GROUP BY 1")
def nested_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("l_orderkey", "l_linenumber", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("block"), place.alias("place"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("value"))
    return collect.nested_frames(rows, "l_partkey")


@query(
    "SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'R') AS n, count(*) AS tracks, sum(('0x' || substr(md5(concat_ws(chr(31), p_partkey, coalesce(p_name, chr(30)), p_size)), 1, 15))::HUGEINT)::VARCHAR AS stamp "
    "FROM (SELECT * FROM part UNION ALL SELECT * FROM part WHERE p_partkey % 2 = 0)"
)
def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a library with repeated rows, which the stamp counts."""
    energy = collect.user_energy(_rows(spark, sf_dir, "lineitem", "l_partkey AS track", "IF(l_returnflag = 'R', 'user', 'x') AS source", "l_linenumber AS energy"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return energy.join(collect.stamp(part.unionByName(part.where("p_partkey % 2 = 0"))))  # one row each


@query(
    "WITH r AS (SELECT p_partkey AS track, p_size AS node, p_partkey AS file, p_partkey % 4 AS audio_hash FROM part JOIN embeddings ON vec_id = p_partkey WHERE p_partkey % 4 = vec_id % 3 AND label % 2 = 0) SELECT track, node::BIGINT AS node, file, audio_hash FROM r WHERE node IN (SELECT node FROM r GROUP BY 1 HAVING count(*) >= 2)"
)
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    library, genres = part.select(F.col("p_partkey").alias("track")), part.select(F.col("p_partkey").alias("track"), F.col("p_size").cast("long").alias("node"))
    files = part.selectExpr("p_partkey AS track", "p_partkey AS file", "p_partkey % 4 AS audio_hash")
    vectors = _rows(spark, sf_dir, "embeddings", "vec_id AS file", "vec_id % 3 AS audio_hash", "IF(label % 2 = 0, 'a', 'b') AS model", "embedding AS vector")
    return collect.training_set(library, genres, files, vectors, "a", 2).select("track", "node", "file", "audio_hash")


@query(
    "WITH p AS (SELECT 'all' AS rows, * FROM part UNION ALL SELECT 'less', * FROM part WHERE p_partkey <> 7), d AS (SELECT rows, sha256(concat_ws(chr(31), p_partkey, coalesce(p_name, chr(30)), coalesce(p_size::VARCHAR, chr(30)))) AS h FROM p) "
    "SELECT rows, sha256(concat_ws('/', count(*), sum(('0x' || substr(h, 1, 15))::HUGEINT), sum(('0x' || substr(h, 16, 15))::HUGEINT))) AS signature FROM d GROUP BY 1"
)
def learning_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of what a model is learned from, of all rows in any order and of one row fewer."""
    part = table(spark, sf_dir, "part")
    sets = {"all": part.orderBy(F.desc("p_name")), "less": part.where("p_partkey <> 7")}
    signed = [collect.signature(df, "p_partkey", "p_name", "p_size").select(F.lit(n).alias("rows"), "signature") for n, df in sets.items()]
    return signed[0].union(signed[1])


@query(
    "WITH t AS (SELECT DISTINCT l_partkey AS track, l_suppkey AS tag FROM lineitem), c AS (SELECT track, count(*) AS n FROM t WHERE track <> 5 AND tag IN (SELECT tag FROM t WHERE track = 5) GROUP BY 1) SELECT p_partkey AS track, CASE WHEN p_size % 4 <> 0 THEN p_type END AS genre, coalesce(n, 0) AS n FROM part LEFT JOIN c ON c.track = p_partkey WHERE p_partkey <> 5"
)
def next_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    genres = _rows(spark, sf_dir, "part", "p_partkey AS track", "p_type AS genre", where="p_size % 4 <> 0")
    rows = collect.candidates(_rows(spark, sf_dir, "part", "p_partkey AS track"), genres, 5)
    common = collect.tags_in_common(_rows(spark, sf_dir, "lineitem", "l_partkey AS track", "l_suppkey AS tag"), 5)
    return rows.join(common, "track", "left").select("track", "genre", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {TRACKS_SQL} SELECT 1 AS crate, recording_id AS track FROM tracks WHERE flags & 1 <> 0 AND {ALL_SQL} UNION ALL SELECT 2, recording_id FROM tracks WHERE flags & 1 <> 0 AND (key_order = 16 OR (rating <> 3 AND rating <> 0) OR NOT (bpm >= 99.5 AND bpm < 100.5))")
def smart_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.evaluated(tracks(spark, sf_dir), {1: RULE_ALL, 2: RULE_ANY})


@query(
    "WITH r AS (SELECT o_custkey AS c, o_orderkey % 50 AS p, o_orderkey AS t FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT DISTINCT o_custkey, o_custkey % 77, o_custkey % 77 FROM orders WHERE o_custkey % 3 = 1) SELECT c_custkey AS crate, c_name AS name, coalesce(string_agg(t, ',' ORDER BY p, t), '') AS tracks FROM customer LEFT JOIN r ON c = c_custkey GROUP BY 1, 2"
)
def crate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = _rows(spark, sf_dir, "orders", "o_custkey AS crate", "o_orderkey % 50 AS place", "o_orderkey AS track", where="o_custkey % 3 = 0")
    smart = _rows(spark, sf_dir, "orders", "o_custkey AS crate", "o_custkey % 77 AS track", where="o_custkey % 3 = 1").distinct()
    out = collect.crate_tree(static, smart, _rows(spark, sf_dir, "customer", "c_custkey AS crate", "c_name AS name"))
    return out.withColumn("tracks", F.array_join(F.col("tracks").cast("array<string>"), ","))


@query("SELECT l_suppkey AS tag, string_agg(DISTINCT l_partkey, ',' ORDER BY l_partkey) AS tracks FROM lineitem GROUP BY 1")
def tag_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collect.tag_playlists(_rows(spark, sf_dir, "lineitem", "l_suppkey AS tag", "l_partkey AS track"))
    return rows.withColumn("tracks", F.array_join(F.col("tracks").cast("array<string>"), ","))


@query(
    "WITH b AS (SELECT o_orderkey AS track, 'f' AS field, 'v' || (o_custkey % 3) AS value, CASE WHEN o_custkey % 2 = 0 THEN 'old' END AS replaced FROM orders WHERE o_orderkey % 5 <> 0), s AS (SELECT o_orderkey AS track, 'f' AS field, 'v' || (o_custkey % 2) AS value FROM orders WHERE o_orderkey % 3 = 0) "
    "SELECT coalesce(b.track, s.track) AS track, coalesce(b.field, s.field) AS field, coalesce(s.value, b.value) AS value, CASE WHEN s.value IS NOT NULL AND s.value IS DISTINCT FROM b.value THEN b.value ELSE b.replaced END AS replaced FROM b FULL JOIN s ON b.track = s.track"
)
def record_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _rows(spark, sf_dir, "orders", "o_orderkey AS track", "'f' AS field", "concat('v', o_custkey % 3) AS value", "IF(o_custkey % 2 = 0, 'old', NULL) AS replaced", where="o_orderkey % 5 <> 0")
    return collect.record_send(base, _rows(spark, sf_dir, "orders", "o_orderkey AS track", "'f' AS field", "concat('v', o_custkey % 2) AS value", where="o_orderkey % 3 = 0"))


@query("SELECT p_partkey AS track, 'local' AS source, p_size::DOUBLE AS bpm, '8A' AS key FROM part UNION ALL SELECT p_partkey, 'external', CASE WHEN p_size % 2 = 0 THEN p_retailprice END, CASE WHEN p_size % 3 = 0 THEN '1A' END FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0")
def attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _rows(spark, sf_dir, "part", "p_partkey AS track", "'local' AS source", "CAST(p_size AS DOUBLE) AS bpm", "'8A' AS key")
    old = _rows(spark, sf_dir, "part", "p_partkey AS track", "'external' AS source", "1D AS bpm", "'9A' AS key", where="p_size % 7 = 0")
    return collect.attach(own.union(old), _rows(spark, sf_dir, "part", "p_partkey AS track", "IF(p_size % 2 = 0, p_retailprice, NULL) AS bpm", "IF(p_size % 3 = 0, '1A', NULL) AS key"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AS chosen FROM orders")
def chosen_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_custkey") % 2 == 0, '["x", "a/b"]').otherwise('["x"]')).when(F.col("o_orderkey") % 3 == 1, "not json")
    return table(spark, sf_dir, "orders").select("o_orderkey", collect.in_chosen(text, ["a/b", "c"]).alias("chosen"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN (0.5 * 2 + 3 * 0.25) / 5 ELSE 0.5 END AS score, p_size % 2 = 0 AS valid FROM part")
def extra_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal that speaks for a third of the tracks (and says nonsense for the others), and reasons of which half lack their parameter."""
    fitness = F.when(F.col("p_size") % 3 == 0, 0.25).when(F.col("p_size") % 3 == 1, 7.0).otherwise(float("nan"))
    score = collect.with_signals(F.lit(0.5), F.lit(2.0), [(F.lit(3.0), fitness), (F.lit(-1.0), F.lit(0.5))])
    valid = collect.reason_valid(collect.reason("nearTempo", "tempo", gap=F.when(F.col("p_size") % 2 == 0, F.col("p_size"))))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), valid.alias("valid"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'dub' ELSE 'live' END AS only_a, CASE WHEN o_custkey % 3 = 0 THEN 'dub,vip' WHEN o_custkey % 3 = 1 THEN 'vip' ELSE '' END AS b FROM orders WHERE o_custkey % 2 = 1 OR o_custkey % 3 <> 0")
def labels_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_custkey % 2 = 1 OR o_custkey % 3 <> 0")
    a = F.array(F.when(F.col("o_custkey") % 2 == 0, "dub").otherwise("live"), F.lit("intro"))
    b = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("vip"), F.lit("dub"), F.lit("intro"))).when(F.col("o_custkey") % 3 == 1, F.array(F.lit("vip"), F.lit("intro"))).otherwise(F.array(F.lit("intro")))
    apart = collect.labels_apart(a, b)
    return orders.select("o_orderkey", F.array_join(apart["only_a"], ",").alias("only_a"), F.array_join(apart["only_b"], ",").alias("b"))


@query(
    "WITH f AS (SELECT p_partkey AS file, p_name AS title, p_brand AS artist, count(*) OVER (PARTITION BY p_name) AS n, count(*) OVER (PARTITION BY p_name, p_brand) AS m FROM part) SELECT a.file AS a, b.file AS b FROM f a JOIN f b ON a.title = b.title AND a.file < b.file AND (a.n <= 20 OR a.artist = b.artist AND a.m <= 20)"
)
def name_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.name_buckets(_rows(spark, sf_dir, "part", "p_partkey AS file", "p_name AS title", "p_brand AS artist"), 20)

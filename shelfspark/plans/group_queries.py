"""Queries of grouping, alignment and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import alignment, grouping
from shelfspark.plans.queries import query, table
from shelfspark.sources.keyed_table import KeyedTable
from shelfspark.storage import new_path, stored
from shelfspark.streaming import feed

MEMBER = {
    "file": "c_custkey",
    "track": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(floor(c_custkey / 2) AS BIGINT) END",
    "akey": "CASE WHEN c_custkey % 5 = 0 THEN concat('k', c_custkey % 60) END",
    "library": "c_custkey % 9 = 0",
}
MEMBERS = ", ".join(f"{e} AS {c}" for c, e in MEMBER.items())
OUTCOME = "CASE WHEN m >= 3 THEN 'duplicate' WHEN m = 2 THEN 'undecided' ELSE 'different' END"
PAIRS_SQL = f"SELECT a, b, {OUTCOME} AS o FROM (SELECT o_custkey AS a, o_custkey + o_orderkey % 3 + 1 AS b, sum(o_orderkey)::BIGINT % 5 AS m FROM orders GROUP BY 1, 2)"
DECIDED = {
    "apart": {"key_a": "concat('k', n_nationkey * 2)", "key_b": "concat('k', n_nationkey * 5)"},
    "same": {"key_a": "concat('k', n_nationkey * 5)", "key_b": "concat('k', n_nationkey * 10)"},
    "links": {"track_a": "n_nationkey * 3", "track_b": "n_nationkey * 3 + 1"},
}
APART, SAME, LINKS = (", ".join(f"{e} AS {c}" for c, e in DECIDED[t].items()) for t in DECIDED)


def _plan_sql(members: str, pairs: str) -> str:
    """The plan by every pair of files of a set."""
    called = lambda t: f"SELECT DISTINCT least(a.node, b.node) AS x, greatest(a.node, b.node) AS y FROM {t} d JOIN h a ON a.akey = d.key_a JOIN h b ON b.akey = d.key_b JOIN nd p ON p.node = a.node JOIN nd q ON q.node = b.node WHERE a.node <> b.node AND (d.key_a <> d.key_b OR (p.lib AND q.lib))"
    across = lambda ends, at, unit: f"SELECT a.s FROM {ends} e JOIN {at} a ON a.node = e.x JOIN {at} b ON b.node = e.y WHERE a.s = b.s AND a.{unit} <> b.{unit}"
    return f"""WITH RECURSIVE m AS (SELECT file, coalesce(track, -file - 1) AS node, akey, library AS lib FROM ({members})), p AS ({pairs}),
nd AS (SELECT node, bool_or(lib) AS lib, min(akey) AS lo, max(akey) AS hi, count(*) AS n, count(akey) AS kn FROM m GROUP BY 1),
h AS (SELECT DISTINCT akey, node FROM m WHERE akey IS NOT NULL),
ap AS ({called(f"(SELECT {APART} FROM nation)")}), sm AS ({called(f"(SELECT {SAME} FROM nation)")}),
lk AS (SELECT track_a AS x, track_b AS y FROM (SELECT {LINKS} FROM nation) EXCEPT SELECT x, y FROM sm),
g1 AS (SELECT node, min(node) OVER (PARTITION BY lo) AS s FROM nd WHERE kn = n AND lo = hi),
at1 AS (SELECT nd.node, lib, coalesce(s, nd.node) AS s, nd.node AS unit FROM nd LEFT JOIN g1 USING (node)),
held1 AS (SELECT s FROM at1 GROUP BY s HAVING count(*) FILTER (lib) >= 2 UNION {across("(SELECT * FROM lk UNION SELECT * FROM ap)", "at1", "unit")}),
u AS MATERIALIZED (SELECT node, lib, CASE WHEN s IN (SELECT s FROM held1) THEN node ELSE s END AS unit FROM at1),
f AS MATERIALIZED (SELECT m.file, m.node, unit, akey, m.lib FROM m JOIN u USING (node)),
su AS MATERIALIZED (SELECT DISTINCT least(a.unit, b.unit) AS x, greatest(a.unit, b.unit) AS y FROM sm JOIN u a ON a.node = x JOIN u b ON b.node = y WHERE a.unit <> b.unit),
ku AS (SELECT DISTINCT akey, unit FROM f WHERE akey IS NOT NULL),
e AS (SELECT fa.unit AS x, fb.unit AS y FROM p JOIN f fa ON fa.file = a JOIN f fb ON fb.file = b WHERE o = 'duplicate' AND fa.unit <> fb.unit UNION SELECT a.unit, b.unit FROM ku a JOIN ku b ON a.akey = b.akey AND a.unit <> b.unit UNION SELECT x, y FROM su),
ee AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT DISTINCT unit AS x, unit AS y FROM u UNION SELECT r.x, ee.y FROM r JOIN ee ON ee.x = r.y),
st AS (SELECT x AS unit, min(y) AS s FROM r GROUP BY 1), at2 AS (SELECT node, u.unit, s FROM u JOIN st USING (unit)),
w AS MATERIALIZED (SELECT f.*, s FROM f JOIN st USING (unit)),
sz AS (SELECT s, count(*) AS files, count(DISTINCT unit) AS units, count(DISTINCT unit) FILTER (lib) AS mine, count(DISTINCT akey) = 1 AND count(akey) = count(*) AS one FROM w GROUP BY 1),
c AS (SELECT a.s, bool_or(coalesce(p.o, 'undecided') = 'different') AS bad, bool_or(coalesce(p.o, 'undecided') = 'undecided') AS open FROM w a JOIN w b ON a.s = b.s AND a.file < b.file AND a.unit <> b.unit
  LEFT JOIN su ON su.x = least(a.unit, b.unit) AND su.y = greatest(a.unit, b.unit) LEFT JOIN p ON p.a = a.file AND p.b = b.file WHERE su.x IS NULL AND NOT coalesce(a.akey = b.akey, false) GROUP BY 1),
v AS (SELECT sz.s, CASE WHEN units = 1 THEN 'single' WHEN mine >= 2 THEN 'library' WHEN sz.s IN ({across("lk", "at2", "unit")}) THEN 'linked' WHEN sz.s IN ({across("ap", "at2", "unit")}) THEN 'apart'
  WHEN one THEN 'merge' WHEN files > 50 OR coalesce(bad, false) THEN 'differ' WHEN coalesce(open, false) THEN 'wait' ELSE 'merge' END AS verdict FROM sz LEFT JOIN c USING (s))
SELECT file, node, unit, s AS "set", verdict FROM w JOIN v USING (s)"""


def _inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    members = table(spark, sf_dir, "customer").select(*(F.expr(e).alias("key" if c == "akey" else c) for c, e in MEMBER.items()))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 3 + 1).alias("b"), "o_orderkey")
    pairs = rows.groupBy("a", "b").agg((F.sum("o_orderkey") % 5).alias("m")).selectExpr("a", "b", f"{OUTCOME} AS outcome")
    nation = table(spark, sf_dir, "nation")
    return [members, pairs, *(nation.select(*(F.expr(e).alias(c) for c, e in columns.items())) for columns in DECIDED.values())]


@query(_plan_sql(f"SELECT {MEMBERS} FROM customer", PAIRS_SQL))
def grouping_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets joined by audio and duplicate pairs, held by library tracks, links and decisions."""
    return grouping.plan(*_inputs(spark, sf_dir))


MEMBERS_AFTER = f"SELECT file, track, CASE WHEN file % 40 = 3 THEN 'k9' ELSE akey END AS akey, library FROM (SELECT {MEMBERS} FROM customer) WHERE file % 45 <> 7"
PAIRS_AFTER = f"SELECT a, b, CASE WHEN a % 50 = 11 THEN 'different' ELSE o END AS o FROM ({PAIRS_SQL}) WHERE a % 35 <> 2"


@query(_plan_sql(MEMBERS_AFTER, PAIRS_AFTER))
def regroup_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan after files and pairs changed, came and went, worked out anew for the sets they touch: as if worked out whole."""
    before = _inputs(spark, sf_dir)
    planned = stored(grouping.plan(*before), "regroup-before")
    members = before[0].where("file % 45 <> 7").withColumn("key", F.when(F.col("file") % 40 == 3, "k9").otherwise(F.col("key")))
    pairs = before[1].where("a % 35 <> 2").withColumn("outcome", F.when(F.col("a") % 50 == 11, "different").otherwise(F.col("outcome")))
    touched = grouping.touched_files(before[0], members, ["file"], ["file"]).unionByName(grouping.touched_files(before[1], pairs, ["a", "b"], ["a", "b"]))
    return grouping.replan(planned, touched, members, pairs, *before[2:])


#: Words of texts as stored fingerprints: 32 bits of each word's digest.
ITEM_SQL = "('0x' || substr(md5(w), 1, 8))::BIGINT"


def _align_sql(rounds: int, least: int, offsets: int) -> str:
    steps = [
        f"""it AS MATERIALIZED (SELECT doc_id AS id, i - 1 AS pos, {ITEM_SQL} AS item FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') AS ws FROM documents))),
ps AS MATERIALIZED (SELECT a, b FROM (SELECT doc_id AS b, min(doc_id) OVER (PARTITION BY md5(array_to_string(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')[2:4], ' '))) AS a, len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) AS n FROM documents) WHERE a < b AND n >= 4),
l0 AS MATERIALIZED (SELECT a, b, pos, item FROM ps JOIN it ON id = a), r0 AS MATERIALIZED (SELECT a, b, pos, item FROM ps JOIN it ON id = b)"""
    ]
    for n in range(rounds):
        steps.append(f"""v{n} AS (SELECT a, b, l.pos - r.pos AS shift, count(*) AS votes FROM l{n} l JOIN r{n} r USING (a, b, item) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY count(*) DESC, l.pos - r.pos) <= {offsets}),
m{n} AS (SELECT l.a, l.b, shift, l.pos AS pa, r.pos AS pb, bit_count(xor(l.item, r.item)) AS bits FROM v{n} JOIN l{n} l USING (a, b) JOIN r{n} r ON r.a = l.a AND r.b = l.b AND r.pos = l.pos - shift WHERE bit_count(xor(l.item, r.item)) < {alignment.MATCH_BITS}),
s{n} AS (SELECT a, b, shift, min(pa) AS start_a, min(pb) AS start_b, count(*) AS items, sum(bits)::BIGINT AS bits FROM (SELECT *, pa - row_number() OVER (PARTITION BY a, b, shift ORDER BY pa) AS run FROM m{n}) GROUP BY a, b, shift, run HAVING count(*) >= {least if n else 1}),
f{n} AS MATERIALIZED (SELECT * FROM s{n} JOIN (SELECT a, b, shift FROM (SELECT a, b, shift, sum(items) AS k, sum(bits) AS d FROM s{n} GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY k DESC, d, shift) = 1) USING (a, b, shift)),
l{n + 1} AS MATERIALIZED (SELECT * FROM l{n} x WHERE NOT EXISTS (SELECT 1 FROM f{n} y WHERE y.a = x.a AND y.b = x.b AND x.pos BETWEEN y.start_a AND y.start_a + y.items - 1)),
r{n + 1} AS MATERIALIZED (SELECT * FROM r{n} x WHERE NOT EXISTS (SELECT 1 FROM f{n} y WHERE y.a = x.a AND y.b = x.b AND x.pos BETWEEN y.start_b AND y.start_b + y.items - 1))""")
    found = " UNION ALL ".join(f"SELECT a, b, {n} AS alignment, start_a, start_b, items, bits FROM f{n}" for n in range(rounds))
    return f"WITH {', '.join(steps)} {found}"


@query(_align_sql(3, 10, alignment.OFFSETS))
def aligned_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two texts with the same second to fourth words match, by their words' stored hashes: the main alignment and two more."""
    space = r"[ \t\n\x0b\f\r]+"
    words = F.filter(F.split("text", space), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", words.alias("ws"))
    begin = docs.where("size(ws) >= 4").select("doc_id", F.md5(F.array_join(F.slice("ws", 2, 3), " ")).alias("k"))
    first = begin.groupBy("k").agg(F.min("doc_id").alias("a"))
    pairs = begin.join(first, "k").where("a < doc_id").select("a", F.col("doc_id").alias("b"))
    lists = docs.select(F.col("doc_id").alias("id"), F.transform("ws", lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long")).alias("items"))
    return alignment.align_lists(pairs, lists, least=10, most=3)


@query("SELECT user_id AS id, count(*) AS events, max(event_id) AS last FROM events GROUP BY 1")
def settled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream of marks, each page of touched users settled into a keyed table."""
    events = table(spark, sf_dir, "events")
    marks = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet").select(F.col("user_id").alias("key"))
    kept = KeyedTable(spark, new_path(spark, "settled"), ["id"], "id long, events long, last long")
    own = events.select(F.col("user_id").alias("id"), "event_id")
    derive = lambda keys: own.join(keys.select(F.col("key").alias("id")), "id", "left_semi").groupBy("id").agg(F.count("*").alias("events"), F.max("event_id").alias("last"))
    feed.settle(marks, derive, kept, new_path(spark, "settled-checkpoint"), "events").awaitTermination()
    return kept.read()


@query("WITH w AS (SELECT o_orderkey AS wish, o_custkey % 40 AS a, o_orderkey % 30 AS t FROM orders WHERE o_orderstatus = 'O'), f AS (SELECT p_partkey AS file, p_size % 40 AS a, p_partkey % 30 AS t FROM part) SELECT wish, min(file) AS acquired FROM w LEFT JOIN f USING (a, t) GROUP BY 1")
def streamed_tick_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open wishes ticked off by a stream of arriving files."""
    part = table(spark, sf_dir, "part")
    arrivals = spark.readStream.schema(part.schema).parquet(f"{sf_dir}/part*.parquet").selectExpr("p_partkey AS file", "CAST(p_size % 40 AS BIGINT) AS artist", "p_partkey % 30 AS title")
    wishes = KeyedTable(spark, new_path(spark, "wishes"), ["wish"], "wish long, artist long, title long, acquired long")
    wishes.replace(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").selectExpr("o_orderkey AS wish", "o_custkey % 40 AS artist", "o_orderkey % 30 AS title", "CAST(NULL AS BIGINT) AS acquired"))
    feed.tick_off(arrivals, wishes, ["artist", "title"], new_path(spark, "wishes-checkpoint"), "files").awaitTermination()
    return wishes.read().select("wish", "acquired")

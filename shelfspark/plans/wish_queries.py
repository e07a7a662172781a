"""Wishes met with tracks by parsed names, and offers, over rows made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import wishes
from shelfspark.plans.queries import query, table

#: How names end, and the kind and the mark of the version that says.
ENDS = [("", "plain", ""), (" (Extended Mix)", "cut", "e"), (" [Clean]", "cut", "c"), (" (Ana Bo Remix)", "rework", "r"), (" - Original Mix", "plain", "")]


def _pick(k: int, at: str) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN '{e[k]}'" for i, e in enumerate(ENDS)) + " END"


WISH_AT, TRACK_AT = "o_orderkey % 5", "p_partkey % 5"
WISH = {"wish": "o_orderkey", "artist": "concat(CASE WHEN o_custkey % 2 = 0 THEN 'The Őrder ' ELSE 'the order ' END, o_custkey % 20, ' & Friend')", "base": "concat('Song No. ', o_orderkey % 30)", "isrc": "CASE WHEN o_orderkey % 9 = 0 THEN concat('gb-abc-24-', 10000 + o_orderkey % 500) END"}
TRACK = {"track": "p_partkey", "artist": "concat('THE ORDER ', p_partkey % 20)", "base": "concat('song no ', p_partkey % 30)", "isrc": "CASE WHEN p_partkey % 7 = 0 THEN concat('GBABC24', 10000 + p_partkey) END", "library": "p_size % 2 = 0"}


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


@query(
    f"WITH w AS (SELECT o_orderkey AS wish, o_custkey % 2 = 1 AS plain, o_custkey % 20 AS a, o_orderkey % 30 AS t, {_pick(1, WISH_AT)} AS kind, {_pick(2, WISH_AT)} AS mark, CASE WHEN o_orderkey % 9 = 0 THEN 10000 + o_orderkey % 500 END AS code FROM orders), "
    f"k AS (SELECT p_partkey AS track, p_partkey % 20 AS a, p_partkey % 30 AS t, {_pick(1, TRACK_AT)} AS kind, {_pick(2, TRACK_AT)} AS mark, CASE WHEN p_partkey % 7 = 0 THEN 10000 + p_partkey END AS code, p_size % 2 = 0 AS library FROM part), "
    "c AS (SELECT code, min(track) AS track FROM k WHERE code IS NOT NULL GROUP BY 1), "
    "b AS (SELECT wish, k.track, CASE WHEN w.mark = k.mark THEN 3 WHEN w.kind <> 'rework' AND k.kind <> 'rework' THEN 2 ELSE 1 END AS r FROM w JOIN k USING (a, t) QUALIFY row_number() OVER (PARTITION BY wish ORDER BY r DESC, library DESC, k.track) = 1) "
    "SELECT wish, CASE WHEN c.track IS NOT NULL OR r = 3 THEN 'owned' WHEN r = 2 THEN 'otherCut' WHEN r = 1 THEN 'rework' ELSE 'missing' END AS outcome, coalesce(c.track, b.track) AS track, c.track IS NOT NULL AS by_isrc FROM w LEFT JOIN c USING (code) LEFT JOIN b USING (wish)"
)
def wishes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wishes by code, else by artist, title and what their labels say."""
    made = lambda df, columns, end: df.select(*(F.expr(e).alias(c) for c, e in columns.items() if c != "base"), F.expr(f"concat({columns['base']}, {end})").alias("name"))
    return wishes.find(made(table(spark, sf_dir, "orders"), WISH, _pick(0, WISH_AT)), made(table(spark, sf_dir, "part"), TRACK, _pick(0, TRACK_AT)))


ENTRY = {"entry": "o_orderkey", "location": "CASE WHEN o_orderkey % 10 = 3 THEN 'tidal:123' ELSE 'file://localhost/x' END", "file": "CASE WHEN o_orderkey % 5 <> 3 THEN o_orderkey END", "probable": "o_orderkey % 4 = 0"}


@query(
    "WITH e AS (SELECT o_orderkey AS entry, o_orderkey % 10 = 3 AS streaming, CASE WHEN o_orderkey % 5 <> 3 THEN o_orderkey END AS file, o_orderkey % 4 = 0 AS probable FROM orders WHERE o_custkey % 6 < 4), "
    "t AS (SELECT l_partkey AS track, bool_or(l_orderkey % 3 <> 0) AS there FROM e JOIN lineitem ON l_orderkey = file WHERE NOT probable GROUP BY 1), "
    "s AS (SELECT CASE WHEN track % 5 = 0 THEN 'inLibrary' WHEN there THEN 'toAdd' ELSE 'missing' END AS state FROM t WHERE track % 11 <> 0 UNION ALL SELECT 'missing' FROM e WHERE file IS NULL AND NOT streaming UNION ALL SELECT 'unconfirmed' FROM e WHERE file IS NOT NULL AND probable) SELECT state, count(*) AS n FROM s GROUP BY 1"
)
def collection_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of four of six playlists: tracks to add, there already, missing, or waiting for a word."""
    orders, lines, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    playlists = F.array(F.concat(F.lit("list "), (F.col("o_custkey") % 6).cast("string")), F.lit("all"))
    entries = orders.select(*(F.expr(e).alias(c) for c, e in ENTRY.items()), playlists.alias("playlists"))
    chosen = orders.select(F.concat(F.lit("list "), (F.col("o_custkey") % 4).cast("string")).alias("path")).distinct()
    tracks = part.select(F.col("p_partkey").alias("track"))
    files = orders.select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 3 != 0).alias("present"))
    return wishes.offered(entries, lines.selectExpr("l_partkey AS track", "l_orderkey AS file"), tracks.where("track % 5 = 0"), tracks.where("track % 11 = 0"), files, chosen)

"""The whole track row worked out from the tables, stored, and read by the list query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import listing, overview, track_table
from shelfspark.plans.derive_queries import COPIES, VERDICT
from shelfspark.plans.queries import query, table
from shelfspark.storage import new_path, stored

# Expressions that both engines read, by column.
TAG = {"title": "CASE WHEN o_custkey % 3 <> 0 THEN concat('Tag ', o_orderkey % 50) END", "artist": "CASE WHEN o_custkey % 2 = 0 THEN concat('Ärtist ', o_custkey % 9) END", "genre": "CASE WHEN o_custkey % 4 = 0 THEN concat('Nation_', o_orderkey % 30) END"}
FRAMES = ", ".join(f"CASE WHEN {e} IS NOT NULL THEN concat('{{\"key\":\"{k}\",\"value\":{{\"type\":\"text\",\"text\":\"', {e}, '\"}}}}') END" for k, e in zip(("TIT2", "TPE1", "TCON"), TAG.values()))
FILE = {
    "file": "o_orderkey", "root": "'Music'", "path": "CASE WHEN o_orderkey % 2 = 0 THEN concat('House/Ümlaut ', o_orderkey, '.mp3') ELSE concat('x', o_orderkey, '.flac') END",
    "format": "CASE WHEN o_orderstatus = 'F' THEN 'flac' ELSE 'mp3' END", "duration_ms": "o_custkey % 400 * 1000", "present": "o_orderstatus <> 'P'", "verdict": VERDICT, "stale": "o_custkey % 7 = 0",
}
ENTRY = {
    "entry": "(l_orderkey * 100000 + l_partkey) * 10 + l_linenumber", "file": "l_orderkey", "probable": "l_linenumber <> 2", "plays": "l_suppkey % 4", "title": "CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE concat('Entry ', l_orderkey) END",
    "artist": "CASE WHEN l_suppkey % 2 = 0 THEN concat('ENTRY artist ', l_suppkey) END", "genre": "CASE WHEN l_suppkey % 5 = 0 THEN concat('nation ', l_suppkey % 30) END", "total_s": "l_suppkey % 5 * 60", "rating": "concat('', l_suppkey % 6 * 51)",
}
LIBRARY = {"track": "p_partkey", "linked": "CASE WHEN p_size % 2 = 0 THEN p_partkey * 7 % 16000 END", "gone": "p_size % 11 = 0", "added_at": "CASE WHEN p_size % 3 = 0 THEN CAST('2024-05-06 07:08:09' AS TIMESTAMP) END"}
VALUES = [
    ("bpm", "user", "p_size % 4 = 0", "concat('', 100 + p_size)"), ("bpm", "tag", "p_size % 3 = 0", "'90.5'"), ("bpm", "guess", "true", "'1'"),
    ("key", "external", "p_size % 5 = 0", "concat('', p_size % 12 + 1, 'A')"), ("key", "local", "p_size % 7 > 2", "'Fm'"),
    ("energy", "mik", "p_size % 2 = 0", "concat('', p_size % 11)"), ("energy", "local", "true", "'9'"), ("energy", "user", "p_size % 9 = 0", "'3'"),
]


def _made(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*(F.expr(e).alias(c) for c, e in columns.items()))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, orders, lines, nation = (table(spark, sf_dir, t) for t in ("part", "orders", "lineitem", "nation"))
    raw_tags = F.expr(f"CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE concat('{{\"id3v2\":[', concat_ws(',', {FRAMES}), ']}}') END")
    files = orders.select(*(F.expr(e).alias(c) for c, e in FILE.items()), raw_tags.alias("raw_tags"))
    values = None
    for field, source, where, value in VALUES:
        one = part.where(where).select(F.col("p_partkey").alias("track"), F.lit(field).alias("field"), F.lit(source).alias("source"), F.expr(value).alias("value"))
        values = one if values is None else values.unionByName(one)
    return track_table.full_rows(
        tracks=part.select(F.col("p_partkey").alias("track"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("created_at")),
        library=_made(part, LIBRARY).where("track % 3 = 0"),
        files=files,
        copies=lines.selectExpr("l_partkey AS track", "l_orderkey AS file", COPIES.split(", ", 2)[2]),
        entries=_made(lines, ENTRY).groupBy("entry").agg(*(F.min(c).alias(c) for c in ENTRY if c != "entry")),  # ids are distinct
        crates=lines.where("l_suppkey < 20").select(F.col("l_partkey").alias("track")),
        values=values,
        nodes=nation.select((F.col("n_nationkey") + 100).cast("long").alias("node"), F.concat(F.lit("Nation_"), F.col("n_nationkey").cast("string")).alias("name"), F.lit(None).cast("long").alias("parent")),
        aliases=spark.createDataFrame([], "alias string, node long"),
    )


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def _by_source(field: str, order: tuple[str, ...]) -> str:
    found = [f"CASE WHEN {w} THEN {v} END" for s in order for f, source, w, v in VALUES if f == field and source == s]
    return f"coalesce({', '.join(found)})"


KEYED = "strip_accents(lower({0}))"
ROWS_SQL = f"""files AS (SELECT {_list(FILE)}, {", ".join(f"CASE WHEN o_custkey % 5 <> 0 THEN {e} END AS t_{c}" for c, e in TAG.items())}, o_custkey % 5 = 0 AS untagged FROM orders),
copies AS (SELECT {COPIES} FROM lineitem), library AS (SELECT * FROM (SELECT {_list(LIBRARY)} FROM part) WHERE track % 3 = 0), entries AS (SELECT entry, {", ".join(f"min({c}) AS {c}" for c in ENTRY if c != "entry")} FROM (SELECT {_list(ENTRY)} FROM lineitem) GROUP BY entry),
best AS (SELECT track, file FROM copies QUALIFY row_number() OVER (PARTITION BY track ORDER BY (role IS NOT DISTINCT FROM 'best') DESC, file) = 1),
shown AS (SELECT p_partkey AS track, p_size, coalesce(l.linked, b.file) AS want, f.* FROM part LEFT JOIN library l ON l.track = p_partkey LEFT JOIN best b ON b.track = p_partkey LEFT JOIN files f ON f.file = coalesce(l.linked, b.file)),
met AS (SELECT c.track, e.* FROM entries e JOIN (SELECT DISTINCT track, file FROM copies) c ON c.file = e.file JOIN files f ON f.file = e.file JOIN shown s ON s.track = c.track WHERE NOT probable
  QUALIFY row_number() OVER (PARTITION BY c.track ORDER BY (e.file IS DISTINCT FROM s.file), NOT f.present, -plays, entry) = 1),
x AS (SELECT s.track AS recording_id, s.file, s.format, coalesce(nullif(trim(m.title), ''), s.t_title, CASE WHEN s.file % 2 = 0 THEN 'Ümlaut ' || s.file ELSE 'x' || s.file END, '') AS title, coalesce(m.artist, s.t_artist) AS artist, coalesce(m.genre, s.t_genre) AS genre,
  s.path, CASE WHEN m.total_s > 0 THEN m.total_s * 1000 ELSE s.duration_ms END AS ms, CASE WHEN m.entry IS NOT NULL THEN (m.rating::INTEGER / 51)::INTEGER END AS rating, l.added_at,
  ({_by_source("bpm", track_table.VALUE_ORDER)})::DOUBLE AS bpm, CASE WHEN p_size % 5 = 0 THEN (p_size % 12 + 1) * 2 WHEN p_size % 7 > 2 THEN 8 END::INTEGER AS key_order, ({_by_source("energy", track_table.ENERGY_ORDER)})::INTEGER AS raw_energy,
  l.track IS NOT NULL AS mine, coalesce(l.gone, false) AS gone, s.present, k.file IS NOT NULL AS linked, k.verdict AS v, k.stale AS st, k.untagged AS u
  FROM shown s LEFT JOIN met m ON m.track = s.track LEFT JOIN library l ON l.track = s.track LEFT JOIN files k ON k.file = l.linked),
trows AS (SELECT recording_id, file, format, title, artist, genre, {KEYED.format("title")} AS title_key, {KEYED.format("artist")} AS artist_key, {KEYED.format("genre")} AS genre_key,
  {KEYED.format("regexp_extract(path, '[^/]*$')")} AS file_key, CASE WHEN path IS NOT NULL THEN CASE WHEN file % 2 = 0 THEN 'music/house' ELSE 'music' END END AS folder_key, bpm, key_order, CASE WHEN ms > 0 THEN ms END AS time_ms, rating,
  CASE WHEN raw_energy BETWEEN 1 AND 10 THEN raw_energy END AS energy, coalesce(added_at, TIMESTAMP '2020-01-01') AS added_at, lower(trim(genre)) AS genre_group,
  CASE WHEN regexp_extract(genre, '[0-9]+')::INTEGER < (SELECT count(*) FROM nation) THEN 100 + regexp_extract(genre, '[0-9]+')::BIGINT END AS genre_node,
  (mine::INTEGER + 2 * (file IS NOT NULL)::INTEGER + 4 * (file IS NULL OR NOT present OR gone)::INTEGER + 8 * coalesce(v IN ('broken', 'truncated', 'transcode', 'lowBitrate') AND NOT st, false)::INTEGER
  + 16 * (EXISTS (SELECT 1 FROM copies c JOIN entries e ON e.file = c.file WHERE c.track = recording_id AND NOT probable))::INTEGER + 32 * (EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = recording_id AND l_suppkey < 20))::INTEGER
  + 64 * (mine AND coalesce(u, true) AND linked)::INTEGER + 128 * (linked AND NOT u)::INTEGER + 256 * (CASE WHEN raw_energy BETWEEN 1 AND 10 THEN raw_energy ELSE 0 END))::BIGINT AS flags FROM x)"""
COLUMNS = [f.split()[0] for f in track_table.ROW.split(", ") if f.split()[0] != "text_hash"]


@query(f"WITH {ROWS_SQL} SELECT {', '.join(COLUMNS)} FROM trows")
def track_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole row of every track: shown fields, sort keys, tempo, key, length, rating, energy, genre node and flags."""
    return rows(spark, sf_dir).select(*COLUMNS)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stored(rows(spark, sf_dir), "track-rows")  # derived once for both
    kept = track_table.table_at(made, new_path(spark, "tracks"))
    kept.sync(made.where("recording_id % 4 <> 0"))
    kept.sync(made)  # writes what differs: the rest
    return kept.read()


PAGE = ["recording_id", "title", "artist", "genre", "bpm", "key_order", "time_ms", "rating", "energy", "file"]


@query(f"WITH {ROWS_SQL} SELECT {', '.join(PAGE)} FROM trows WHERE flags & 1 <> 0 AND flags & 128 <> 0 ORDER BY (folder_key IS NULL), folder_key DESC, recording_id DESC LIMIT 200 OFFSET 5")
def stored_page_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the library by folder, read from the stored rows."""
    q = {"source": "library", "filters": [{"kind": "missingArt"}], "sort": {"column": "folder_key", "descending": True}, "offset": 5, "limit": 200}
    return listing.page(_stored(spark, sf_dir), q).select(*PAGE)


@query(f"WITH {ROWS_SQL} SELECT {', '.join(PAGE)} FROM trows WHERE flags & 2 <> 0 AND energy = 4 ORDER BY (time_ms IS NULL), time_ms, recording_id LIMIT 500")
def stored_page_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {"source": "all", "filters": [{"kind": "energy", "level": 4}], "sort": {"column": "time_ms"}}
    return listing.page(_stored(spark, sf_dir), q).select(*PAGE)


@query(f"WITH {ROWS_SQL} SELECT genre, count(*) AS n FROM trows WHERE flags & 1 <> 0 AND genre IS NOT NULL GROUP BY 1")
def stored_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres of the library from the stored rows."""
    return _stored(spark, sf_dir).where("flags & 1 <> 0 AND genre IS NOT NULL").groupBy("genre").agg(F.count("*").alias("n"))


@query(f"WITH {ROWS_SQL} SELECT flags & (3840 | 8 | 64 | 128) AS mix, count(*) AS n FROM trows GROUP BY 1")
def stored_flag_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.flag_mix(_stored(spark, sf_dir))

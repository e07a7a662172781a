"""One query per operator over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import music, text
from shelfspark.operators import changelog, decisions, genres, linkage, listing, membership, overview, playlists, recommend, search_index, similar
from shelfspark.operators.graph import connected_components
from shelfspark.plans.catalogue import TRACKS_SQL, tracks
from shelfspark.sources import readers
from shelfspark.storage import new_path
from shelfspark.streaming import bursts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WITH = f"WITH {TRACKS_SQL}"
PAGE = ["recording_id", "title", "artist", "bpm", "key_order", "energy", "genre"]
PAGE_SQL = ", ".join(PAGE)


@query(f"{WITH} SELECT {PAGE_SQL} FROM tracks WHERE flags & 2 <> 0 AND format IN ('mp3', 'flac') AND flags & 4 = 4 ORDER BY title_key, artist_key NULLS LAST, recording_id LIMIT 100 OFFSET 3")
def table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {"source": "all", "filters": [{"kind": "format", "format": "mp3"}, {"kind": "format", "format": "flac"}, {"kind": "missing"}], "offset": 3, "limit": 100}
    return listing.page(tracks(spark, sf_dir), q).select(*PAGE)


@query(f"{WITH} SELECT {PAGE_SQL} FROM tracks WHERE flags & 1 <> 0 ORDER BY (bpm IS NULL), bpm DESC, recording_id DESC LIMIT 200")
def table_page_by_bpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(tracks(spark, sf_dir), {"source": "library", "sort": {"column": "bpm", "descending": True}, "limit": 200}).select(*PAGE)


@query(f"{WITH} SELECT {PAGE_SQL} FROM tracks WHERE flags & 1 <> 0 ORDER BY (artist_key IS NULL), artist_key, title_key, recording_id LIMIT 300 OFFSET 50")
def table_page_by_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(tracks(spark, sf_dir), {"source": "library", "sort": {"column": "artist"}, "offset": 50, "limit": 300}).select(*PAGE)


def _playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("recording_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))


@query(f"{WITH} SELECT position, {PAGE_SQL} FROM (SELECT l_partkey AS recording_id, l_orderkey * 10 + l_linenumber AS position FROM lineitem) JOIN tracks USING (recording_id) ORDER BY position, recording_id LIMIT 500")
def table_page_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(tracks(spark, sf_dir), {"source": "playlist", "limit": 500}, _playlist(spark, sf_dir)).select("position", *PAGE)


@query(f"{WITH} SELECT count(*) AS total FROM tracks WHERE flags & 1 <> 0 AND (flags & 3840) >> 8 = 7 AND genre_group = 'promo'")
def table_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.total(tracks(spark, sf_dir), {"source": "library", "filters": [{"kind": "energy", "level": 7}, {"kind": "genre", "genre": " Promo"}]})


@query(f"{WITH}, placed AS (SELECT recording_id, row_number() OVER (ORDER BY (genre_group IS NULL), genre_group DESC, title_key DESC, recording_id DESC) - 1 AS position FROM tracks WHERE flags & 2 <> 0) SELECT position FROM placed WHERE recording_id = 90")
def table_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.position(tracks(spark, sf_dir), {"source": "all", "sort": {"column": "genre", "descending": True}}, 90)


@query(f"{WITH} SELECT DISTINCT format FROM tracks WHERE flags & 1 <> 0")
def table_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.formats(tracks(spark, sf_dir), "library")


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])the') AND regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])licen')")
def fulltext_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting table is written once and only the ranges of the two beginnings are read again."""
    docs = table(spark, sf_dir, "documents")
    index = search_index.build(docs, "doc_id", ["text"], new_path(spark, "postings"))
    return search_index.find(index, "The  licen -- ").withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "source"), "doc_id")


@query(f"{WITH} SELECT flags & (3840 | 8 | 64 | 128) AS mix, count(*) AS n FROM tracks GROUP BY 1")
def flags_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.flag_mix(tracks(spark, sf_dir))


@query(f"{WITH} SELECT l.energy, count(t.recording_id) AS n FROM range(1, 11) l(energy) LEFT JOIN tracks t ON t.energy = l.energy AND t.flags & 1 <> 0 GROUP BY 1")
def energy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.energy_bars(tracks(spark, sf_dir))


RULE_ALL = {"combine": "all", "conditions": [{"field": "bpm", "op": "between", "value": 120, "to": 90, "halfDouble": True}, {"field": "energy", "op": "atLeast", "value": 4}, {"field": "genre", "op": "contains", "value": "aR"}]}
RULE_ANY = {"combine": "any", "conditions": [{"field": "key", "op": "is", "value": "8a"}, {"field": "rating", "op": "isNot", "value": 3}, {"field": "bpm", "op": "isNot", "value": 100}, {"field": "key", "op": "is", "value": "zz"}]}
ALL_SQL = "(bpm >= 89.5 AND bpm < 120.5 OR bpm >= 44.75 AND bpm < 60.25 OR bpm >= 179 AND bpm < 241) AND energy >= 4 AND genre_group LIKE '%ar%'"


@query(f"{WITH} SELECT recording_id FROM tracks WHERE flags & 1 <> 0 AND {ALL_SQL}")
def smart_rule_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = tracks(spark, sf_dir).select("recording_id").limit(0)
    return membership.smart_members(tracks(spark, sf_dir), RULE_ALL, none, none)


@query(f"{WITH} SELECT recording_id FROM tracks WHERE flags & 1 <> 0 AND (key_order = 16 OR (rating <> 3 AND rating <> 0) OR NOT (bpm >= 99.5 AND bpm < 100.5))")
def smart_rule_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = tracks(spark, sf_dir).select("recording_id").limit(0)
    return membership.smart_members(tracks(spark, sf_dir), RULE_ANY, none, none)


@query(f"{WITH} SELECT recording_id FROM tracks WHERE flags & 1 <> 0 AND {ALL_SQL} AND recording_id NOT IN (SELECT ps FROM (SELECT p_partkey AS ps FROM part WHERE p_size = 12)) UNION SELECT p_partkey FROM part WHERE p_size = 50")
def smart_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda size: table(spark, sf_dir, "part").where(f"p_size = {size}").select(F.col("p_partkey").alias("recording_id"))
    return membership.smart_members(tracks(spark, sf_dir), RULE_ALL, ids(50), ids(12))


@query(
    f"{WITH} SELECT count(*) AS tracks, coalesce(sum(time_ms), 0)::BIGINT AS total_ms, count(*) FILTER (flags & 4 <> 0) AS missing, count(*) FILTER (flags & 8 <> 0) AS low_quality, "
    "count(*) FILTER (flags & 64 <> 0) AS missing_tags, count(*) FILTER (flags & 128 <> 0) AS missing_art, count(*) FILTER (bpm IS NOT NULL AND key_order IS NOT NULL) AS analyzed FROM tracks WHERE flags & 1 <> 0"
)
def overview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.totals(tracks(spark, sf_dir))


@query(f"{WITH} SELECT count(*) AS tracks, count(*) FILTER (flags & 1 = 0) AS outside FROM tracks")
def overview_all_music(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.all_music(tracks(spark, sf_dir))


@query("SELECT min_by(c_mktsegment, (-n, c_mktsegment)) AS genre, sum(n)::BIGINT AS tracks FROM (SELECT lower(c_mktsegment) AS g, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY g")
def genre_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))
    return overview.rank_genres(table(spark, sf_dir, "customer").select(spelled.alias("genre")))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("crate_id"), F.col("l_partkey").alias("recording_id"))


@query(
    f"{WITH}, own AS (SELECT l_suppkey AS crate_id, tracks.* FROM lineitem JOIN tracks ON l_partkey = recording_id), "
    "top AS (SELECT crate_id, genre_group, row_number() OVER (PARTITION BY crate_id ORDER BY count(*) DESC, genre_group) AS p FROM own WHERE genre_group IS NOT NULL GROUP BY 1, 2) "
    "SELECT crate_id, count(*) AS tracks, coalesce(sum(time_ms), 0)::BIGINT AS total_ms, min(bpm) AS bpm_min, max(bpm) AS bpm_max, min(energy) AS energy_min, max(energy) AS energy_max, count(DISTINCT key_order) AS keys, "
    "any_value(t.list) AS top_genres FROM own LEFT JOIN (SELECT crate_id, string_agg(genre_group, ', ' ORDER BY p) AS list FROM top WHERE p <= 3 GROUP BY 1) t USING (crate_id) GROUP BY crate_id"
)
def crate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.crate_summary(_entries(spark, sf_dir), tracks(spark, sf_dir))


@query(
    "WITH k AS (SELECT o_orderpriority AS genre, o_orderkey % 24 + 2 AS known, o_custkey % 24 + 2 AS est FROM orders), "
    "d AS (SELECT genre, least(abs(known // 2 - est // 2), 12 - abs(known // 2 - est // 2)) AS s, known % 2 = est % 2 AS same FROM k), "
    "c AS (SELECT genre, CASE WHEN s = 0 AND same THEN 'exact' WHEN s = 0 THEN 'relative' WHEN s = 1 AND same THEN 'one_step' WHEN s = 3 AND NOT same THEN 'parallel' ELSE 'other' END AS k FROM d) "
    "SELECT genre, count(*) AS tracks, " + ", ".join(f"count(*) FILTER (k = '{k}') AS {k}" for k in ("exact", "relative", "one_step", "parallel", "other")) + " FROM c GROUP BY ROLLUP (genre)"
)
def key_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("genre"), (F.col("o_orderkey") % 24 + 2).alias("known"), (F.col("o_custkey") % 24 + 2).alias("estimated"))
    return overview.key_agreement(pairs)


TARGET = {"recording_id": 30, "key_order": 8, "bpm": 100.0, "energy": 5}
GAP_SQL = "CASE WHEN abs(bpm - 100) <= abs(bpm * 2 - 100) AND abs(bpm - 100) <= abs(bpm / 2 - 100) THEN bpm - 100 WHEN abs(bpm * 2 - 100) <= abs(bpm / 2 - 100) THEN bpm * 2 - 100 ELSE bpm / 2 - 100 END"
KEY_SQL = "least(abs(key_order // 2 - 4), 12 - abs(key_order // 2 - 4)) AS steps, key_order % 2 = 0 AS same"


@query(
    f"{WITH}, f AS (SELECT recording_id, abs({GAP_SQL}) AS spread, {KEY_SQL} FROM tracks), "
    "p AS (SELECT recording_id, spread, (CASE WHEN steps = 0 AND same THEN 3 WHEN steps = 1 AND same OR steps = 0 THEN 2 ELSE 0 END + CASE WHEN spread <= 2 THEN 3 WHEN spread <= 4 THEN 2 WHEN spread <= 8 THEN 1 ELSE 0 END) AS points FROM f) "
    "SELECT recording_id, points, CASE WHEN points >= 5 THEN 3 WHEN points = 4 THEN 2 WHEN points >= 2 THEN 1 ELSE 0 END AS dots, spread FROM p"
)
def fit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.fit_order(tracks(spark, sf_dir), TARGET)


@query(
    f"{WITH}, f AS (SELECT recording_id, energy, abs({GAP_SQL}) AS gap, {KEY_SQL} FROM tracks WHERE recording_id <> 30), "
    "p AS (SELECT recording_id, energy, coalesce(CASE WHEN steps = 0 AND same THEN 1.0 WHEN steps = 1 AND same OR steps = 0 THEN 2.0 / 3 ELSE 0 END, 0)::DOUBLE AS k, "
    "coalesce(CASE WHEN gap <= 2 THEN 1.0 WHEN gap <= 4 THEN 2.0 / 3 WHEN gap <= 8 THEN 1.0 / 3 ELSE 0 END, 0)::DOUBLE AS b, "
    "CASE abs(energy - 5) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE CASE WHEN energy IS NULL THEN NULL ELSE 0 END END::DOUBLE AS e FROM f), "
    "s AS (SELECT *, (k * 4 + b * 4 + coalesce(e, 0) * 2) / (8 + CASE WHEN e IS NULL THEN 0 ELSE 2 END) AS raw FROM p) "
    "SELECT recording_id, round(raw * 100)::INTEGER AS score, concat_ws(',', CASE WHEN k > 0 AND k >= b AND k * 4 >= coalesce(e, 0) * 2 THEN 'key' END, CASE WHEN b > 0 AND b * 4 >= coalesce(e, 0) * 2 THEN 'bpm' END, "
    "CASE WHEN k > 0 AND k < b AND k * 4 >= coalesce(e, 0) * 2 THEN 'key' END, CASE WHEN e > 0 THEN 'energy' END, CASE WHEN k > 0 AND k * 4 < coalesce(e, 0) * 2 THEN 'key' END, CASE WHEN b > 0 AND b * 4 < coalesce(e, 0) * 2 THEN 'bpm' END) AS reasons, "
    "e IS NULL AS lacks_energy FROM s ORDER BY e IS NULL, raw DESC, recording_id LIMIT 10"
)
def next_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.next_for(tracks(spark, sf_dir), TARGET)


def _key_fits(a: int) -> str:
    steps, same = f"least(abs(key_order // 2 - {a // 2}), 12 - abs(key_order // 2 - {a // 2}))", f"key_order % 2 = {a % 2}"
    return f"coalesce(CASE WHEN {steps} = 0 AND {same} THEN 1.0 WHEN {steps} = 0 OR ({steps} = 1 AND {same}) THEN 0.8 WHEN {steps} = 2 AND {same} THEN 0.5 WHEN {steps} = 1 THEN 0.4 END, 0)::DOUBLE"


def _tempo_fits(t: int) -> str:
    gap = f"least(abs(bpm - {t}), abs(bpm * 2 - {t}), abs(bpm / 2 - {t}))"
    return f"coalesce(CASE WHEN {gap} <= 3 THEN 1.0 WHEN {gap} <= 6 THEN 0.75 WHEN {gap} <= 12 THEN 0.5 WHEN {gap} <= 20 THEN 0.25 END, 0)::DOUBLE"


@query(
    f"{WITH}, f AS (SELECT recording_id, energy IS NULL AS lacks, least({_key_fits(8)}, {_key_fits(12)}) AS k, least({_tempo_fits(100)}, {_tempo_fits(110)}) AS b, "
    "CASE abs(round(energy - 6.5)) WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 0 END::DOUBLE AS e FROM tracks WHERE recording_id NOT IN (30, 31)), "
    "s AS (SELECT recording_id, lacks AS lacks_energy, (k * 4 + b * 4 + CASE WHEN lacks THEN 0 ELSE e * 2 END) / CASE WHEN lacks THEN 8 ELSE 10 END AS raw, "
    "array_to_string(list_transform(list_filter(list_sort([{'w': -k * 4, 'i': 0, 'n': 'key'}, {'w': -b * 4, 'i': 1, 'n': 'bpm'}, {'w': CASE WHEN lacks THEN 0 ELSE -e * 2 END, 'i': 2, 'n': 'energy'}]), lambda x: x.w < 0), lambda x: x.n), ',') AS reasons FROM f) "
    "SELECT recording_id, round(raw * 100)::INTEGER AS score, reasons, lacks_energy FROM s WHERE round(raw * 100) > 0 AND reasons <> '' ORDER BY lacks_energy, raw DESC, recording_id LIMIT 50"
)
def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.bridge(tracks(spark, sf_dir), TARGET, {"recording_id": 31, "key_order": 12, "bpm": 110.0, "energy": 8}, recommend.Settings(wide=True))


TARGET_CURVE = [(0.0, 3.0), (0.5, 8.0), (1.0, 5.0)]


@query(
    f"{WITH}, e AS (SELECT l_orderkey AS playlist_id, l_linenumber AS position, tracks.* FROM lineitem JOIN tracks ON l_partkey = recording_id), "
    "w AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY playlist_id) AS n, coalesce(sum(time_ms) OVER (PARTITION BY playlist_id ORDER BY position, recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms, "
    "lead(bpm) OVER o AS nb, lead(key_order) OVER o AS nk, lead(energy) OVER o AS ne FROM e WINDOW o AS (PARTITION BY playlist_id ORDER BY position, recording_id)), "
    "x AS (SELECT *, CASE WHEN n > 1 THEN i / (n - 1) ELSE 0 END AS place, least(abs(key_order // 2 - nk // 2), 12 - abs(key_order // 2 - nk // 2)) AS steps, key_order % 2 = nk % 2 AS same, "
    "least(abs(nb - bpm), abs(nb * 2 - bpm), abs(nb / 2 - bpm)) AS gap FROM w) "
    "SELECT playlist_id, position, recording_id, start_ms, round(CASE WHEN place <= 0.5 THEN 3 + 5 * place / 0.5 ELSE 8 - 3 * (place - 0.5) / 0.5 END, 6) AS target, "
    "CASE WHEN i + 1 = n THEN NULL WHEN steps IS NULL THEN 'unknown' WHEN steps = 0 OR steps = 1 AND same THEN 'fine' ELSE 'clash' END AS key_flow, "
    "CASE WHEN i + 1 = n THEN NULL WHEN bpm IS NULL OR nb IS NULL THEN 'unknown' WHEN gap <= 8 THEN 'fine' ELSE 'clash' END AS bpm_flow, "
    "CASE WHEN i + 1 = n THEN NULL WHEN ne - energy IS NULL THEN 'unknown' WHEN abs(ne - energy) <= 2 THEN 'fine' ELSE 'clash' END AS energy_flow FROM x"
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("playlist_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("recording_id"))
    return playlists.timeline(own.join(tracks(spark, sf_dir), "recording_id"), TARGET_CURVE)


@query("SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE src <> dst GROUP BY 1, 2")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playlists.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


SESSIONS_SQL = "s AS (SELECT *, sum(CASE WHEN gap <= INTERVAL 12 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events))"


@query(f"WITH {SESSIONS_SQL} SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS plays FROM s GROUP BY user_id, s")
def sessions_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playlists.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 12 * 3600)


@query(f"WITH {SESSIONS_SQL}, m AS (SELECT *, min(ts) OVER (PARTITION BY user_id, s) AS first FROM s) SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS plays FROM m GROUP BY user_id, s, floor((epoch_us(ts) - epoch_us(first)) / 86400000000)")
def sessions_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playlists.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 12 * 3600, 24 * 3600)


@query("WITH s AS (SELECT *, sum(CASE WHEN gap < INTERVAL 12 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS plays FROM s GROUP BY user_id, s")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "12 hours")


@query(
    "WITH d AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings), m AS (SELECT i, avg(x) AS m FROM d GROUP BY i), "
    "c AS (SELECT vec_id, list(x - m ORDER BY i) AS v FROM d JOIN m USING (i) GROUP BY vec_id), t AS (SELECT v AS tv FROM c WHERE vec_id = 7), "
    "r AS (SELECT vec_id, list_cosine_similarity(v, tv) AS c FROM c, t WHERE vec_id <> 7 ORDER BY c DESC, vec_id LIMIT 25) SELECT vec_id, round(c, 6) AS cosine, round(100 * least(greatest(c, 0), 1))::INTEGER AS percent FROM r"
)
def sounds_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.sounds_like(table(spark, sf_dir, "embeddings"), 7)


def _rank_sql(x: str) -> str:
    """Mid-rank of a column that has no nulls."""
    return f"(count(*) OVER (ORDER BY {x} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 2 - count(*) OVER (PARTITION BY {x})) / 2.0::DOUBLE / count(*) OVER ()"


@query(
    f"WITH a AS (SELECT event_id, round(value) AS x, user_id AS y FROM events), s AS (SELECT event_id, (0.0::DOUBLE + {_rank_sql('x')} + {_rank_sql('y')}) / 2 AS score FROM a), "
    f"f AS (SELECT event_id, score, {_rank_sql('score')} AS r FROM s) SELECT event_id, round(score, 9) AS score, least(greatest(floor(r * 10) + 1, 1), 10)::INTEGER AS level FROM f"
)
def energy_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.round("value").alias("a"), F.col("user_id").alias("b"))
    return similar.energy_score(rows, ["a", "b"]).select("event_id", F.round("score", 9).alias("score"), "level")


@query(
    "WITH o AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () - 1 AS m FROM orders), c AS (SELECT k, m * k / 100 AS p FROM range(0, 101) r(k), (SELECT max(m) AS m FROM o)) "
    "SELECT k::INTEGER AS k, round(a.x + (b.x - a.x) * (p - floor(p)), 6) AS cut FROM c JOIN o a ON a.i = floor(p) JOIN o b ON b.i = ceil(p)"
)
def cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.cut_points(table(spark, sf_dir, "orders"), "o_totalprice").select("k", F.round("cut", 6).alias("cut"))


@query()
def genre_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    found = similar.guesses(similar.genre_model(rows), rows)
    return found.select("vec_id", F.transform("guesses", lambda g: g["label"]).alias("labels"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as the items of an entry."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("items"))
    return rows.select("l_orderkey", linkage.sampled_keys(F.col("items")).alias("keys"))


MIX_SQL = (
    "m1 AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS k, (xor(l_partkey, l_partkey >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT AS x FROM lineitem), "
    "m2 AS (SELECT id, k, (xor(x, x >> 13)::HUGEINT * 3266489909 % 4294967296)::BIGINT AS x FROM m1), keys AS (SELECT id, k FROM m2 WHERE xor(x, x >> 16) % 4 = 0), "
    "sets AS (SELECT id, list(k ORDER BY k) AS ks FROM keys GROUP BY id), entry AS (SELECT ks, min(id) AS e FROM sets GROUP BY ks), ek AS (SELECT e, unnest(ks) AS k FROM entry), "
    "ok AS (SELECT k FROM ek GROUP BY k HAVING count(*) BETWEEN 2 AND 200)"
)


@query(f"WITH {MIX_SQL} SELECT a.e AS a, b.e AS b, count(*) AS n FROM ek a JOIN ek b ON a.k = b.k AND a.e < b.e WHERE a.k IN (SELECT k FROM ok) GROUP BY 1, 2 HAVING count(*) >= 2")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.block_pairs(_keys(spark, sf_dir), "l_orderkey", "keys")


@query("SELECT doc_id AS id, keeper, copies FROM documents JOIN (SELECT text, min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1) USING (text)")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.exact_groups(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("SELECT l_orderkey, files, l_linenumber, l_quantity FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey) AS files, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_quantity DESC, l_linenumber) AS p FROM lineitem) WHERE p = 1")
def best_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("l_returnflag") == "R", -F.col("l_quantity"), F.col("l_linenumber")]
    return linkage.best_record(table(spark, sf_dir, "lineitem"), "l_orderkey", order, ["l_linenumber", "l_quantity"])


PAIRS_SQL = "SELECT o_custkey AS a, o_custkey + o_orderkey % 3 + 1 AS b, sum(o_orderkey)::BIGINT % 5 AS m FROM orders GROUP BY 1, 2"


@query(
    f"WITH RECURSIVE p AS ({PAIRS_SQL}), e AS (SELECT a, b FROM p WHERE m = 4 UNION SELECT b, a FROM p WHERE m = 4), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) "
    "SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a"
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_pairs(spark, sf_dir).where("m = 4"), "a", "b")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 3 + 1).alias("b"), "o_orderkey")
    return rows.groupBy("a", "b").agg((F.sum("o_orderkey") % 5).alias("m"))


@query(
    f"WITH RECURSIVE p AS ({PAIRS_SQL}), f AS (SELECT c_custkey AS file, c_custkey // 2 AS track, c_custkey % 9 = 0 AS lib FROM customer), d AS (SELECT a, b, CASE WHEN m = 4 THEN 'duplicate' WHEN m = 3 THEN 'undecided' ELSE 'different' END AS o FROM p), "
    "e AS (SELECT a, b FROM d WHERE o = 'duplicate' UNION SELECT b, a FROM d WHERE o = 'duplicate'), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), "
    'c AS (SELECT a AS file, least(a, min(b)) AS "set" FROM r GROUP BY a), own AS (SELECT * FROM c JOIN f USING (file)), '
    'n AS (SELECT "set", count(*) AS n, count(DISTINCT track) FILTER (lib) AS mine FROM own GROUP BY 1), '
    'x AS (SELECT a."set", count(*) AS pairs, count(*) FILTER (o = \'duplicate\') AS dup, count(*) FILTER (o = \'undecided\') AS undecided FROM own a JOIN own b ON a."set" = b."set" AND a.file < b.file AND a.track <> b.track LEFT JOIN d ON d.a = a.file AND d.b = b.file GROUP BY 1) '
    "SELECT file, \"set\", CASE WHEN coalesce(undecided, 0) > 0 THEN 'wait' WHEN n <= 50 AND mine <= 1 AND coalesce(dup, 0) = coalesce(pairs, 0) THEN 'merge' ELSE 'review' END AS verdict FROM own JOIN n USING (\"set\") LEFT JOIN x USING (\"set\")"
)
def merge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    files = table(spark, sf_dir, "customer").select(key.alias("file"), F.floor(key / 2).alias("track"), (key % 9 == 0).alias("library"))
    outcome = F.when(F.col("m") == 4, "duplicate").when(F.col("m") == 3, "undecided").otherwise("different")
    return linkage.merge_sets(files, _pairs(spark, sf_dir).select("a", "b", outcome.alias("outcome")))


RELINK_E = "SELECT o_orderkey AS entry, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || o_orderkey ELSE '' END AS path_key, 't' || (o_orderkey // 7) AS title_key, o_custkey % 300 AS total_s FROM orders"
RELINK_F = "SELECT o_orderkey AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_orderkey ELSE 'q' END AS path_key, 't' || (o_orderkey // 5) AS title_key, o_custkey % 300 * 1000 + o_orderkey % 2000 AS duration_ms FROM orders"


def _alone_sql(name: str, method: str, confidence: float, cond: str, e: str, f: str) -> str:
    pairs = f"{name}p AS (SELECT DISTINCT entry, file FROM {e} e JOIN {f} f ON {cond})"
    return f"{pairs}, {name} AS (SELECT entry, file, '{method}' AS method, {confidence}::DOUBLE AS confidence FROM {name}p WHERE entry IN (SELECT entry FROM {name}p GROUP BY 1 HAVING count(*) = 1) AND file IN (SELECT file FROM {name}p GROUP BY 1 HAVING count(*) = 1))"


FITS_SQL = "f.duration_ms >= e.total_s * 1000 - 500 AND f.duration_ms < e.total_s * 1000 + 1500"
RELINK_SQL = (
    f"WITH e0 AS ({RELINK_E}), f0 AS ({RELINK_F}), " + _alone_sql("s1", "path", 1.0, "e.path_key = f.path_key AND e.path_key <> ''", "e0", "f0")
    + ", e1 AS (SELECT * FROM e0 WHERE entry NOT IN (SELECT entry FROM s1)), f1 AS (SELECT * FROM f0 WHERE file NOT IN (SELECT file FROM s1)), "
    + _alone_sql("s2", "name and duration", 0.9, f"e.title_key = f.title_key AND {FITS_SQL}", "e1", "f1")
    + ", e2 AS (SELECT * FROM e1 WHERE entry NOT IN (SELECT entry FROM s2)), f2 AS (SELECT * FROM f1 WHERE file NOT IN (SELECT file FROM s2)), "
    + _alone_sql("s3", "name", 0.5, "e.title_key = f.title_key", "e2", "f2")
    + " SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3"
)


@query(RELINK_SQL)
def relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    e = orders.select(key.alias("entry"), F.when(key % 3 == 0, F.concat(F.lit("p"), key)).otherwise("").alias("path_key"), F.concat(F.lit("t"), F.floor(key / 7)).alias("title_key"), (F.col("o_custkey") % 300).alias("total_s"))
    f = orders.select(key.alias("file"), F.when(key % 2 == 0, F.concat(F.lit("p"), key)).otherwise("q").alias("path_key"), F.concat(F.lit("t"), F.floor(key / 5)).alias("title_key"), (F.col("o_custkey") % 300 * 1000 + key % 2000).alias("duration_ms"))
    return linkage.relink(e, f)


@query("WITH e AS (SELECT c_custkey AS entry, (c_custkey * 7 % 5000)::BIGINT AS total_s FROM customer), f AS (SELECT o_orderkey AS file, (o_orderkey * 13 % 5000000)::BIGINT AS duration_ms FROM orders) SELECT entry, file FROM e JOIN f ON duration_ms >= total_s * 1000 - 500 AND duration_ms < total_s * 1000 + 1500")
def range_join_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry"), (F.col("c_custkey") * 7 % 5000).alias("total_s"))
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") * 13 % 5_000_000).alias("duration_ms"))
    return linkage.duration_join(e, f)


@query("SELECT o_custkey, o_orderkey, c_name FROM (SELECT o_custkey, o_orderkey, o_custkey // 3 AS k FROM orders) LEFT JOIN (SELECT c_custkey // 3 AS k, min(c_mktsegment) AS c_name FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = 1) USING (k)")
def unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_custkey") / 3).alias("k"))
    targets = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 3).alias("k"), F.col("c_mktsegment").alias("c_name"))
    return linkage.unique_lookup(rows, targets, "k", "c_name").select("o_custkey", "o_orderkey", "c_name")


@query(
    "WITH a AS (SELECT p_partkey AS k, nullif(p_size, 7) AS x, p_brand AS y FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey AS k, nullif(p_size, 8) AS x, CASE WHEN p_partkey % 9 = 0 THEN 'other' ELSE p_brand END AS y FROM part WHERE p_partkey % 11 <> 0) "
    "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.x IS NOT DISTINCT FROM b.x AND a.y IS NOT DISTINCT FROM b.y THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k"
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    a = part.where("k % 10 <> 0").select("k", F.nullif("p_size", F.lit(7)).alias("x"), F.col("p_brand").alias("y"))
    b = part.where("k % 11 <> 0").select("k", F.nullif("p_size", F.lit(8)).alias("x"), F.when(F.col("k") % 9 == 0, "other").otherwise(F.col("p_brand")).alias("y"))
    return linkage.changed(a, b, "k", ["x", "y"])


@query(
    "WITH a AS (SELECT p_partkey AS id, s, CASE WHEN (p_partkey + s) % 3 = 0 THEN NULL ELSE p_size + s END AS bpm, CASE WHEN (p_partkey + s) % 2 = 0 THEN NULL ELSE p_brand || s END AS key FROM part, range(0, 4) r(s)), "
    "n AS (SELECT s, ['external', 'tag', 'mik', 'local'][s + 1] AS source FROM range(0, 4) r(s)) SELECT id, min_by(bpm, s) FILTER (bpm IS NOT NULL)::BIGINT AS bpm, min_by(source, s) FILTER (bpm IS NOT NULL) AS bpm_source, min_by(key, s) FILTER (key IS NOT NULL) AS key, min_by(source, s) FILTER (key IS NOT NULL) AS key_source FROM a JOIN n USING (s) GROUP BY id"
)
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_brand", F.posexplode(F.array(*map(F.lit, ("external", "tag", "mik", "local")))).alias("s", "source"))
    rows = part.select("id", "source", "s", F.when((F.col("id") + F.col("s")) % 3 != 0, (F.col("p_size") + F.col("s")).cast("long")).alias("bpm"), F.when((F.col("id") + F.col("s")) % 2 != 0, F.concat("p_brand", "s")).alias("key"))
    return linkage.pick_first(rows, "id", F.col("s"), ["bpm", "key"])


@query(
    "WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 3 END AS app, o_orderkey % 3 AS ext, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 2 END AS base, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 ELSE NULL END AS rep, o_orderkey % 11 <> 0 AS there, o_orderkey % 13 = 0 AS stale, o_orderkey % 2 = 0 AS derived, CASE WHEN o_orderkey % 17 = 0 THEN 'id' ELSE 'genre' END AS field FROM orders) "
    "SELECT id, CASE WHEN field = 'id' THEN 'never' WHEN stale THEN 'wait' WHEN NOT there THEN 'send' WHEN app IS NULL THEN 'take' WHEN base IS NULL THEN CASE WHEN app = ext THEN 'same' WHEN rep = ext THEN 'send' ELSE 'conflict' END "
    "WHEN ext = base THEN CASE WHEN app <> base THEN 'send' ELSE 'same' END WHEN app = base THEN CASE WHEN rep = ext THEN 'notTakenUp' WHEN derived THEN 'review' ELSE 'take' END WHEN app = ext THEN 'same' ELSE 'conflict' END AS decision FROM o"
)
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = decisions.merge_decision(
        F.when(k % 17 == 0, "id").otherwise("genre"), F.when(k % 5 != 0, c % 3), k % 3, F.when(k % 7 != 0, c % 2), F.when(k % 4 == 0, k % 3), k % 11 != 0, k % 13 == 0, k % 2 == 0
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), d.alias("decision"))


@query(
    "WITH l AS (SELECT l_orderkey AS id, l_linenumber AS line, l_linenumber % 2 = 0 AS lossless, 100 + (l_quantity * 5)::BIGINT AS kbps, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 15000 + l_partkey % 7000 END AS cut, CASE WHEN l_suppkey % 5 = 0 THEN 32000 ELSE 44100 END AS sr, CASE WHEN l_partkey % 41 = 0 THEN 2 ELSE 0 END AS err, 100000 + l_suppkey % 50 * 100 AS dec, 100000 + l_partkey % 60 * 100 AS hdr FROM lineitem) "
    "SELECT id, line, CASE WHEN err > 0 THEN 'broken' WHEN hdr - dec > 2000 AND (hdr - dec) * 100 > hdr THEN 'truncated' WHEN lossless AND cut < 19500 AND sr / 2 > 19500 THEN 'transcode' WHEN NOT lossless AND kbps >= 254 AND cut < 17000 AND sr / 2 > 17000 THEN 'transcode' WHEN NOT lossless AND kbps < 190 THEN 'lowBitrate' WHEN cut IS NOT NULL THEN 'ok' END AS verdict FROM l"
)
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    lossless = F.col("l_linenumber") % 2 == 0
    v = decisions.quality(
        F.when(lossless, "flac").otherwise("mp3"), lossless, 100 + (F.col("l_quantity") * 5).cast("long"), F.when(p % 6 != 0, 15000 + p % 7000), F.when(s % 5 == 0, 32000).otherwise(44100), F.when(p % 41 == 0, 2).otherwise(0), 100000 + s % 50 * 100, 100000 + p % 60 * 100
    )
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), v.alias("verdict"))


AUDIO, NAMES = ("identical", "full", "inside", "partial", "none", "uncompared", "unknown"), ("same", "cut", "rework", "unclear", "mashup", "title", "artists")


@query(
    "WITH t(audio, names, outcome) AS (VALUES ('full', 'same', 'duplicate'), ('full', 'cut', 'cut'), ('full', 'rework', 'review'), ('full', 'unclear', 'review'), ('full', 'mashup', 'review'), ('full', 'title', 'review'), ('full', 'artists', 'duplicate'), "
    "('inside', 'same', 'cut'), ('inside', 'cut', 'cut'), ('inside', 'unclear', 'cut'), ('inside', 'rework', 'review'), ('inside', 'title', 'review'), ('inside', 'mashup', 'rework'), ('inside', 'artists', 'cut'), "
    "('partial', 'mashup', 'rework'), ('partial', 'same', 'review'), ('partial', 'unclear', 'review'), ('partial', 'artists', 'review'), ('partial', 'cut', 'cut'), ('partial', 'rework', 'rework'), ('partial', 'title', 'different'), ('none', 'same', 'different'), ('uncompared', 'same', 'review'), ('unknown', 'same', 'review')), "
    "a AS (SELECT unnest(['none', 'uncompared', 'unknown']) AS audio), n AS (SELECT unnest(['cut', 'rework', 'artists', 'mashup', 'unclear', 'title']) AS names), "
    "f AS (SELECT * FROM t UNION ALL SELECT audio, names, CASE WHEN names IN ('cut', 'rework') THEN names ELSE 'different' END FROM a, n UNION ALL SELECT 'identical', unnest(['same', 'cut', 'rework', 'unclear', 'mashup', 'title', 'artists']), 'duplicate'), "
    f"l AS (SELECT {list(AUDIO)}[l_partkey % 7 + 1] AS audio, {list(NAMES)}[l_suppkey % 7 + 1] AS names, l_linenumber % 2 = 0 AS truncated, ['same', 'cut', 'rework', 'unclear', NULL][l_linenumber % 5 + 1] AS labels FROM lineitem), "
    "r AS (SELECT *, CASE WHEN names = 'title' AND (audio = 'full' AND labels IS NOT NULL OR audio = 'inside' AND labels IN ('cut', 'rework')) THEN labels ELSE names END AS rel FROM l) "
    "SELECT r.audio, r.names, CASE WHEN r.audio = 'inside' AND r.names = 'same' AND truncated THEN 'duplicate' ELSE outcome END AS outcome, count(*) AS n FROM r JOIN f ON f.audio = r.audio AND f.names = r.rel GROUP BY ALL"
)
def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(pick(AUDIO, "l_partkey").alias("audio"), pick(NAMES, "l_suppkey").alias("names"), "l_linenumber")
    labels = F.get(F.array(*map(F.lit, ("same", "cut", "rework", "unclear", None))), F.col("l_linenumber") % 5)
    out = decisions.pair_outcome(F.col("audio"), F.col("names"), F.col("l_linenumber") % 2 == 0, labels)
    return rows.groupBy("audio", "names", out.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN e % 9 = 0 THEN 'checking' WHEN e % 4 = 0 AND e % 8 = 0 THEN 'better' WHEN e % 4 = 0 THEN 'already' WHEN e % 5 = 0 THEN 'otherCut' WHEN e % 7 = 0 THEN 'rework' ELSE 'new' END AS label, count(*) AS n FROM (SELECT event_id AS e FROM events) GROUP BY 1")
def inbox_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    label = decisions.inbox_label(e % 9 != 0, e % 4 == 0, e % 8 == 0, F.when(e % 5 == 0, "cut").when(e % 7 == 0, "rework"))
    return table(spark, sf_dir, "events").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("node"), F.initcap(F.lower("n_name")).alias("name"), (F.col("n_regionkey") + 10).cast("long").alias("parent"))
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 10).cast("long").alias("node"), F.initcap(F.lower("r_name")).alias("name"), F.lit(1).cast("long").alias("parent"))
    root = spark.range(1, 2).select(F.col("id").alias("node"), F.lit("World").alias("name"), F.lit(None).cast("long").alias("parent"))
    return nation.unionByName(region).unionByName(root)


@query("SELECT n_nationkey + 100 AS node, unnest([n_regionkey + 10, 1])::BIGINT AS ancestor, unnest([1, 2]) AS depth FROM nation UNION ALL SELECT r_regionkey + 10, 1, 1 FROM region")
def folder_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.descendants(_tree(spark, sf_dir).select("node", "parent"))


@query(
    "WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey), e AS (SELECT n_regionkey + 10 AS node, count(*) AS entries, count(DISTINCT c_custkey % 100) AS tracks FROM c GROUP BY 1 UNION ALL SELECT 1, count(*), count(DISTINCT c_custkey % 100) FROM c), "
    "t AS (SELECT n_regionkey + 10 AS node, count(*) AS nodes, 1 AS levels FROM nation GROUP BY 1 UNION ALL SELECT 1, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region), 2) SELECT node::BIGINT AS node, nodes, levels, coalesce(entries, 0) AS entries, coalesce(tracks, 0) AS tracks FROM t LEFT JOIN e USING (node)"
)
def folder_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("node"), (F.col("c_custkey") % 100).alias("recording_id"))
    return membership.folder_contents(_tree(spark, sf_dir).select("node", "parent"), entries)


#: How a customer spells its nation, and what that resolves to.
SPELT = [
    ("concat(substr(n_name, 1, 1), lower(substr(n_name, 2)))", "'exact'"),
    ("'  ' || upper(n_name) || '!'", "'folded'"),
    ("r_name || ' (' || lower(n_name) || ')'", "'sub'"),
    ("'land no ' || n_nationkey", "CASE WHEN n_nationkey % 2 = 0 THEN 'alias' END"),
    ("'nowhere ' || c_custkey", "NULL"),
]


def _spelt(k: int) -> str:
    return "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN {f[k]}" for i, f in enumerate(SPELT)) + " END"


@query(f"SELECT DISTINCT spelling, CASE WHEN how IS NOT NULL THEN (n_nationkey + 100)::BIGINT END AS node, how FROM (SELECT {_spelt(0)} AS spelling, {_spelt(1)} AS how, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
def genre_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of customers' nations: as named, folded, with the region in front, by an alias, or unknown."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("Land-No. "), F.col("n_nationkey").cast("string")).alias("alias"), (F.col("n_nationkey") + 100).cast("long").alias("node"))
    return genres.resolve(rows.select(F.expr(_spelt(0)).alias("spelling")), _tree(spark, sf_dir), aliases)


@query("SELECT node, count(c_custkey) AS n FROM (SELECT n_nationkey + 100 AS node FROM nation UNION ALL SELECT r_regionkey + 10 FROM region UNION ALL SELECT 1) LEFT JOIN customer ON c_nationkey + 100 = node GROUP BY node")
def genre_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("at"))
    return genres.tree_counts(rows, _tree(spark, sf_dir), "at").select("node", "n")


@query("SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k long")["k"]).alias("k"), F.count("*").alias("n"))


LOG_SQL = "WITH c AS (SELECT event_id AS seq, event_id // 5 AS operation, 'track' AS entity, user_id AS id, event_type AS field, CASE WHEN value > 50 THEN NULL ELSE 'b' || event_id END AS before, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'v' || event_id END AS after, event_id // 5 % 7 = 0 AS undone FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, op = F.col("event_id"), F.floor(F.col("event_id") / 5)
    cols = [e.alias("seq"), op.alias("operation"), F.lit("track").alias("entity"), F.col("user_id").alias("id"), F.col("event_type").alias("field")]
    return table(spark, sf_dir, "events").select(*cols, F.when(F.col("value") <= 50, F.concat(F.lit("b"), e)).alias("before"), F.when(e % 10 != 0, F.concat(F.lit("v"), e)).alias("after"), (op % 7 == 0).alias("undone"))


@query(f"{LOG_SQL} SELECT entity, id, field, after AS value FROM c WHERE seq <= 700 AND NOT undone QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY seq DESC) = 1 AND after IS NOT NULL")
def changelog_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.as_of(_log(spark, sf_dir), 700)


@query(f"{LOG_SQL}, o AS (SELECT entity, id, field, arg_min(coalesce(before, chr(1)), seq) AS v, max(seq) AS last FROM c WHERE operation = 152 GROUP BY ALL), x AS (SELECT entity, id, field, nullif(v, chr(1)) AS value, EXISTS (SELECT 1 FROM c WHERE c.id = o.id AND c.field = o.field AND c.seq > o.last AND NOT undone AND operation <> 152) AS clash FROM o) SELECT *, NOT (SELECT bool_or(clash) FROM x) AS allowed FROM x")
def changelog_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.undo(_log(spark, sf_dir), 152)


@query(
    "WITH k AS (SELECT p_partkey, (p_partkey % 13)::INTEGER AS n, p_size % 5 AS how FROM part) SELECT p_partkey, CASE how WHEN 0 THEN CASE WHEN n BETWEEN 1 AND 12 THEN n * 2 END WHEN 1 THEN CASE WHEN n BETWEEN 1 AND 12 THEN n * 2 + 1 END WHEN 2 THEN CASE WHEN n BETWEEN 1 AND 12 THEN ((n + 6) % 12 + 1) * 2 END "
    "WHEN 3 THEN [16, 20, 6, 24, 2, 12, 18, 4, 10, 22, 14, 8, NULL][n + 1] ELSE [17, 21, 7, 25, 3, 13, 19, 5, 11, 23, 15, 9, NULL][n + 1] END AS ord FROM k"
)
def key_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in wheel, Open Key and classical notation, built from a table's numbers, read to places on the wheel."""
    n, how = (F.col("p_partkey") % 13).cast("int"), F.col("p_size") % 5
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), n)
    minor = pick("Am", "Bm", "A#m", "C#m", "G# minor", "Gm", "Em", "Eb min", "Cm", "F#m", "D m", "Fm", "Hm")
    major = pick("C", "D", "Db", "E", "B major", "Bb", "G", "Gb", "Eb", "A", "F", "Ab", "x")
    raw = F.when(how == 0, F.concat(n.cast("string"), F.lit("A"))).when(how == 1, F.concat(F.lit(" 0"), n.cast("string"), F.lit("b"))).when(how == 2, F.concat(n.cast("string"), F.lit("m"))).when(how == 3, minor).otherwise(major)
    return table(spark, sf_dir, "part").select("p_partkey", music.any_key_order(raw).alias("ord"))


@query("SELECT p_partkey AS id, 'Brand ' || p_brand AS artist, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Mix ' || p_size END AS version FROM part")
def pasted_wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    line = F.concat((p % 100).cast("string"), F.lit(". 1:02:03 Brand "), "p_brand", F.lit("  - "), "p_name", F.when(p % 2 == 0, F.concat(F.lit(" (Mix "), "p_size", F.lit(")"))).otherwise(""))
    rows = table(spark, sf_dir, "part").select(p.alias("id"), line.alias("value"))
    clean = text.collapse_spaces(text.strip_time(text.strip_number(F.col("value"))))
    parts = rows.select("id", text.split_artist_title(clean).alias("t")).select("id", "t.artist", text.split_version(F.col("t.title")).alias("v"))
    return parts.select("id", "artist", "v.title", "v.version")


@query("SELECT l_orderkey, '<NODE Name=\"' || l_orderkey || '\" Type=\"1\" Entries=\"' || count(*) || '\">' || string_agg('<TRACK Key=\"' || l_partkey || '\"/>', '' ORDER BY l_linenumber, l_partkey) || '</NODE>' AS xml FROM lineitem GROUP BY l_orderkey")
def playlist_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("recording_id"))
    return readers.playlist_lines(rows, "l_orderkey")

"""Functions over columns of the tables: each raw value is built by an expression both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import music, text
from shelfspark.operators import decisions, filters, genres, recommend, review
from shelfspark.plans.catalogue import TRACKS_SQL, tracks
from shelfspark.plans.queries import QUERIES, SQL, query, table


def _cases(name: str, about: str, cases: dict[str, tuple[str, Callable[[Column], Column], str]]) -> None:
    """Register a query over ``part``: for each column its raw value, the function, and the SQL of what it gives."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = table(spark, sf_dir, "part")
        return part.select("p_partkey", *(f(F.expr(raw)).alias(c) for c, (raw, f, _) in cases.items()))

    run.__name__, run.__doc__ = name, about
    QUERIES[name] = run
    SQL[name] = "SELECT p_partkey, " + ", ".join(f"{want} AS {c}" for c, (_, _, want) in cases.items()) + " FROM part"


WORD = "trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))"
_cases(
    "parsed_values",
    "Years, tempi, energies, ratings and recording codes read from texts.",
    {
        "year": (
            "CASE p_partkey % 4 WHEN 0 THEN ' ' || (1950 + p_size) || '-05-03' WHEN 1 THEN '' || p_size WHEN 2 THEN 'x' || p_size ELSE '' || (9960 + p_size) END",
            text.parse_year,
            "CASE p_partkey % 4 WHEN 0 THEN 1950 + p_size WHEN 3 THEN CASE WHEN 9960 + p_size <= 9999 THEN 9960 + p_size END END::INTEGER",
        ),
        "bpm": (
            "CASE p_partkey % 5 WHEN 0 THEN (60 + p_size) || ' BPM' WHEN 1 THEN (60 + p_size) || ',5' WHEN 2 THEN '1,' || (200 + p_size) WHEN 3 THEN '' || (280 + p_size) ELSE (60 + p_size) || '.25bpm' END",
            text.parse_bpm,
            "CASE p_partkey % 5 WHEN 0 THEN 60 + p_size WHEN 1 THEN 60.5 + p_size WHEN 3 THEN CASE WHEN 280 + p_size <= 300 THEN 280 + p_size END WHEN 4 THEN 60.25 + p_size END::DOUBLE",
        ),
        "energy": (
            "CASE p_partkey % 4 WHEN 0 THEN 'Energy ' || (p_size % 12) WHEN 1 THEN '8A - energy level: ' || (p_size % 12) WHEN 2 THEN 'x E' || (p_size % 12) || ' y' ELSE 'E' || p_size || 'x' END",
            text.parse_energy,
            "CASE WHEN p_partkey % 4 < 3 AND p_size % 12 BETWEEN 1 AND 10 THEN (p_size % 12)::INTEGER END",
        ),
        "stars": ("CASE p_partkey % 3 WHEN 0 THEN '' || (p_size % 6 * 51) WHEN 1 THEN ' ' ELSE '' || (p_size * 2 + 1) END", text.stars_of, "CASE p_partkey % 3 WHEN 0 THEN p_size % 6 WHEN 1 THEN 0 ELSE CASE WHEN p_size * 2 + 1 = 51 THEN 1 END END::INTEGER"),
        "isrc": ("CASE p_partkey % 2 WHEN 0 THEN 'us-ab1 23-' || (10000 + p_size) ELSE 'us-ab1-' || p_size END", text.isrc, "CASE p_partkey % 2 WHEN 0 THEN 'USAB123' || (10000 + p_size) END"),
        "day": ("'live 2023-02-' || lpad('' || (p_size % 40), 2, '0') || ' late'", text.date_in, "TRY_CAST('2023-02-' || lpad('' || (p_size % 40), 2, '0') AS DATE)"),
    },
)
PATH = "CASE p_partkey % 2 WHEN 0 THEN 'C:/Music & more/' || p_brand || '/a+ ' || p_size || '.mp3' ELSE 'D:\\\\' || p_brand || '\\\\b' || p_size || '.' END"
PATH_SQL = "CASE p_partkey % 2 WHEN 0 THEN 'C:/Music & more/' || p_brand || '/a+ ' || p_size || '.mp3' ELSE 'D:\\' || p_brand || '\\b' || p_size || '.' END"
CODED = "replace(replace(replace(replace(replace(x, '%', '%25'), ' ', '%20'), '&', '%26'), '+', '%2B'), '#', '%23')"
_cases(
    "path_parts",
    "Folders, file names, and addresses there and back.",
    {
        "folder": (PATH, text.folder_of, "CASE p_partkey % 2 WHEN 0 THEN 'C:/Music & more/' || p_brand ELSE 'D:\\' || p_brand END"),
        "file": (PATH, text.file_name, "CASE p_partkey % 2 WHEN 0 THEN 'a+ ' || p_size || '.mp3' ELSE 'b' || p_size || '.' END"),
        "file_text": (PATH, text.file_name_text, "CASE p_partkey % 2 WHEN 0 THEN 'a+ ' || p_size ELSE 'b' || p_size || '.' END"),
        "address": (PATH, text.location_encode, f"'file://localhost/' || {CODED.replace('x,', f'replace({PATH_SQL}, chr(92), chr(47)),', 1)}"),
        "back": (PATH, lambda p: text.location_decode(text.location_encode(p)), f"replace({PATH_SQL}, chr(92), chr(47))"),
    },
)
_cases(
    "text_parts",
    "Title keys, featured names, escapes, and tags in comments.",
    {
        "title_key": ("p_name || ' (feat. Some & One) [Mix!]'", text.title_key, f"{WORD} || ' mix'"),
        "main": ("p_name || ' ft. Some One'", text.drop_featuring, "p_name"),
        "xml": ("p_name || ' <&\"''>' || chr(9) || chr(1)", text.xml_escape, "p_name || ' &lt;&amp;&quot;&apos;&gt;&#9;' || chr(65533)"),
        "tags": ("p_name || ' /* a' || p_size || ' / b c */ end'", lambda c: F.array_join(text.tags_in_comment(c), ";"), "'a' || p_size || ';b c'"),
        "comment": ("p_name || ' /* a' || p_size || ' / b c */'", text.without_tags, "p_name"),
        "numberless": ("CASE p_partkey % 2 WHEN 0 THEN p_size || '. ' || p_name ELSE '[1:02:03] ' || p_name END", lambda c: text.strip_time(text.strip_number(c)), "p_name"),
    },
)


@query(
    "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN (p_size % 3 * 1000)::BIGINT ELSE p_partkey % 500 END AS time_ms, coalesce(abs(p_size * 100 - nullif(p_partkey % 60, 0) * 100) <= 1000, false) AS alike, "
    "p_partkey % 60 * 100 >= p_size * 100 - 500 AND p_partkey % 60 * 100 < p_size * 100 + 1500 AS fits, coalesce(nullif(p_size % 11, 0), 0) * 256 AS bits, p_size % 11 AS level FROM part"
)
def lengths_and_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    level = F.nullif(size % 11, F.lit(0))
    cells = {
        "time_ms": music.time_ms(F.nullif(size % 3, F.lit(0)), key % 500),
        "alike": music.about_as_long(size * 100, F.nullif(key % 60, F.lit(0)) * 100),
        "fits": music.duration_fits(size / 10, key % 60 * 100),
        "bits": music.energy_bits(level),
        "level": music.energy_of(music.energy_bits(level)),
    }
    return table(spark, sf_dir, "part").select("p_partkey", *(v.alias(c) for c, v in cells.items()))


KINDS = "['internal', 'external', 'network'][p_size % 3 + 1]"
WHERE = "CASE p_partkey % 5 WHEN 0 THEN 'c:\\users\\me\\downloads\\' || p_name WHEN 1 THEN 'C:/Users/me/Downloads2/' || p_name WHEN 2 THEN '\\\\?\\C:\\Temp\\x\\' || p_name WHEN 3 THEN 'C:/users/ME/./Downloads' ELSE 'E:/' || p_name END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 3) THEN 'downloads' WHEN p_partkey % 5 = 2 THEN 'temp' ELSE nullif({KINDS}, 'internal') END AS why FROM part")
def fragile_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below the downloads or a temporary folder, or on a drive that may go; compared part by part, without letter case."""
    kind = F.get(F.array(*map(F.lit, ("internal", "external", "network"))), F.col("p_size") % 3)
    why = decisions.fragile(F.expr(WHERE.replace("\\", "\\\\")), kind, "C:\\Users\\me\\Downloads", ["c:/temp"])
    return table(spark, sf_dir, "part").select("p_partkey", why.alias("why"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'identical' WHEN p_partkey % 11 = 0 THEN 'uncompared' WHEN s <= 4 AND a >= 0.9 AND b >= 0.9 THEN 'full' WHEN s <= 4 AND (a >= 0.9 OR b >= 0.9) THEN 'inside' WHEN a > 0 OR b > 0 THEN 'partial' ELSE 'none' END AS audio, "
    "(p_size % 3 <> 0)::INTEGER + (p_size % 5 <> 0)::INTEGER AS filled FROM (SELECT *, p_size % 11 / 10.0 AS a, p_partkey % 11 / 10.0 AS b, p_size % 9 AS s FROM part)"
)
def audio_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    cover = F.when(key % 11 != 0, (key % 11) / 10.0)
    case = decisions.audio_case(key % 13 == 0, (size % 11) / 10.0, cover, (size % 9).cast("double"))
    filled = review.tags_filled(F.when(size % 3 != 0, "x"), F.when(size % 5 != 0, "y").otherwise(" "), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", case.alias("audio"), filled.alias("filled"))


#: A filter of each kind and its SQL.
CHIPS = {
    "missing": ({}, "flags & 4 <> 0"), "inExternal": ({}, "flags & 16 <> 0"), "notInExternal": ({}, "flags & 16 = 0"), "inCrate": ({}, "flags & 32 <> 0"), "inNoCrate": ({}, "flags & 32 = 0"),
    "inLibrary": ({}, "flags & 1 <> 0"), "notInLibrary": ({}, "flags & 1 = 0"), "lowQuality": ({}, "flags & 8 <> 0"), "qualityProblem": ({}, "flags & 8 <> 0 AND flags & 2 <> 0"),
    "analyzed": ({}, "bpm IS NOT NULL AND key_order IS NOT NULL"), "notAnalyzed": ({}, "bpm IS NULL OR key_order IS NULL"), "missingTags": ({}, "flags & 64 <> 0"), "missingArt": ({}, "flags & 128 <> 0"),
    "energy": ({"level": 4}, "energy = 4"), "noEnergy": ({}, "flags & 1 <> 0 AND energy IS NULL"), "genre": ({"genre": "PROMO "}, "genre_group = 'promo'"), "format": ({"format": "wav"}, "format = 'wav'"),
    "tag": ({"tag": "t3"}, "recording_id % 7 = 3"),
}


@query(f"WITH {TRACKS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER ({sql}) AS n FROM tracks" for k, (_, sql) in CHIPS.items()))
def filter_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tracks each kind of filter keeps, all in one pass."""
    rows = tracks(spark, sf_dir).withColumn("tags", F.array(F.concat(F.lit("t"), (F.col("recording_id") % 7).cast("string"))))
    counts = [F.count(F.when(filters.condition([{"kind": k, **more}]), 1)).alias(k) for k, (more, _) in CHIPS.items()]
    one = rows.agg(*counts)
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in CHIPS))).alias("c")).select("c.*")


#: Smart conditions that other queries leave out, with their SQL.
RULES = {
    "tag has": ({"field": "tag", "op": "has", "value": "t3"}, "recording_id % 7 = 3"),
    "tag has not": ({"field": "tag", "op": "hasNot", "value": "t3"}, "recording_id % 7 <> 3"),
    "tag unknown": ({"field": "tag", "op": "hasNot", "value": "t9"}, "false"),
    "in crate": ({"field": "inCrate", "op": "is"}, "flags & 32 <> 0"),
    "not external": ({"field": "inExternal", "op": "isNot"}, "flags & 16 = 0"),
    "bpm half": ({"field": "bpm", "op": "is", "value": 140, "halfDouble": True}, "(bpm >= 139.5 AND bpm < 140.5) OR (bpm >= 69.75 AND bpm < 70.25) OR (bpm >= 279 AND bpm < 281)"),
    "key is not": ({"field": "key", "op": "isNot", "value": "8A"}, "key_order <> 16"),
    "rating at most": ({"field": "rating", "op": "atMost", "value": 3}, "rating BETWEEN 1 AND 3"),
}


@query(f"WITH {TRACKS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({sql}) AS n FROM tracks" for k, (_, sql) in RULES.items()))
def smart_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).withColumns({"tags": F.array(F.concat(F.lit("t"), (F.col("recording_id") % 7).cast("string"))), "known_tags": F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.concat(F.lit("t"), k.cast("string")))})
    counts = [F.count(F.when(filters.rule({"combine": "all", "conditions": [c]}), 1)).alias(k) for k, (c, _) in RULES.items()]
    one = rows.agg(*counts)
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n")) for k in RULES))).alias("c")).select("c.*")


FITNESS_SQL = (
    "c AS (SELECT recording_id, recording_id % 5 AS played, recording_id % 8 AS node, CASE WHEN recording_id % 8 > 3 THEN recording_id % 8 - 4 END AS parent, recording_id % 3 AS shared FROM tracks WHERE recording_id <> 11), "
    "f AS (SELECT recording_id, 1 - power(0.5, least(played, 30)) AS f_played, CASE WHEN node = 6 THEN 1.0 WHEN parent = 2 OR parent = 6 OR node = 2 THEN 0.5 ELSE 0.0 END AS f_genre, least(shared / 2.0, 1.0) AS f_tags FROM c)"
)


@query(f"WITH {TRACKS_SQL}, {FITNESS_SQL} SELECT recording_id, f_played, f_genre::DOUBLE AS f_genre, f_tags::DOUBLE AS f_tags, (2 * f_played + 3 * f_genre + f_tags) / 6 AS raw FROM f")
def other_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitness by plays together, genre (the same, a sibling, a parent or a child) and tags in common, and their weighted mean."""
    key = F.col("recording_id")
    rows = tracks(spark, sf_dir).withColumns(
        {"played": key % 5, "genre_node": key % 8, "genre_parent": F.when(key % 8 > 3, key % 8 - 4), "tags": F.slice(F.array(F.lit("a"), F.lit("b")), 1, (key % 3).cast("int"))}
    )
    target = {"recording_id": 11, "played": True, "genre": (6, 2), "tags": ["a", "b"]}
    found = recommend.score(rows, target, recommend.Settings({"played": 2, "genre": 3, "tags": 1}))
    return found.select("recording_id", "f_played", "f_genre", "f_tags", "raw")


@query(
    f"WITH {TRACKS_SQL}, g AS (SELECT genre, count(*) AS n FROM tracks WHERE flags & 1 <> 0 AND genre IS NOT NULL GROUP BY 1), t AS (SELECT DISTINCT lower(p_type) AS name FROM part WHERE p_partkey % 3 <> 0) "
    "SELECT genre AS spelling, n AS tracks FROM g WHERE lower(genre) NOT IN (SELECT name FROM t WHERE name < 'm') UNION ALL SELECT NULL, count(*) FROM tracks WHERE flags & 1 <> 0 AND genre IS NULL"
)
def unmapped_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of the library that no node of the tree stands for, with their tracks, and the tracks without a genre."""
    names = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.lower("p_type").alias("name")).distinct().where("name < 'm'")
    nodes = names.select(F.xxhash64("name").alias("node"), "name", F.lit(None).cast("long").alias("parent"))
    aliases = spark.createDataFrame([], "alias string, node long")
    return genres.unmapped(tracks(spark, sf_dir).where("flags & 1 <> 0"), nodes, aliases)

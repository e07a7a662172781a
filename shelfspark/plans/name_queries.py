"""Queries of the name, path and tag functions over names built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import music, names, releases
from shelfspark.plans.queries import query, table


def _with(spark: SparkSession, sf_dir: str, name: str, **made: str) -> DataFrame:
    """A table with columns made by expressions that both engines read."""
    return table(spark, sf_dir, name).select("*", *(F.expr(e).alias(c) for c, e in made.items()))


KEYS_SQL = "SELECT p_partkey, trim(regexp_replace(replace(replace(replace(strip_accents(lower(t)), 'ß', 'ss'), '&', ' and '), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS version_key, lower(rtrim(t)) AS sibling_key, replace(upper(replace(t, 'ß', chr(1))), chr(1), 'ß') AS upcase FROM (SELECT p_partkey, concat(p_name, CASE p_size % 4 WHEN 0 THEN ' & Ünder' WHEN 1 THEN '''s Straße ' WHEN 2 THEN ' (Éxtra-Mix) ' ELSE '  ' END) AS t FROM part)"


@query(KEYS_SQL)
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.when(F.col("p_size") % 4 == 0, " & Ünder").when(F.col("p_size") % 4 == 1, "'s Straße ").when(F.col("p_size") % 4 == 2, " (Éxtra-Mix) ").otherwise("  ")
    t = F.concat("p_name", ends)
    return table(spark, sf_dir, "part").select("p_partkey", names.version_key(t).alias("version_key"), names.sibling_key(t).alias("sibling_key"), names.upcase(t).alias("upcase"))


@query(
    "WITH c AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, CASE p_size % 5 WHEN 0 THEN ' & ' WHEN 1 THEN ', ' WHEN 2 THEN ' x ' WHEN 3 THEN ' feat. ' ELSE ' ' END AS j, p_size % 5 AS k FROM part) "
    "SELECT p_partkey, CASE WHEN k < 2 THEN a || '|' || b WHEN k = 2 THEN a || ' x ' || b WHEN k = 3 THEN a || ' feat. ' || b ELSE a || ' ' || b END AS names, "
    "array_to_string(list_sort(list_distinct(CASE WHEN k < 4 THEN [a, b, trim(regexp_replace(regexp_replace(replace(a || j || b, '&', ' and '), '[^a-z]+', ' ', 'g'), ' +', ' ', 'g'))] ELSE [a || ' ' || b] END)), '|') AS keys, "
    "CASE WHEN k = 2 THEN a || '|' || b END AS mashup, k < 4 OR a = a || ' ' || b AS shares FROM c"
)
def artist_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, size = table(spark, sf_dir, "part"), F.col("p_size") % 5
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    credit = F.concat(a, F.when(size == 0, " & ").when(size == 1, ", ").when(size == 2, " x ").when(size == 3, " feat. ").otherwise(" "), b)
    listed = lambda x: F.array_join(x, "|")
    return part.select(
        "p_partkey", listed(names.split_names(credit)).alias("names"), listed(names.artist_keys(credit)).alias("keys"), listed(names.mashup_parts(credit)).alias("mashup"), names.artists_match(credit, F.upper(a)).alias("shares")
    )


ASIDES = "CASE o_orderkey % 9 WHEN 0 THEN concat(o_custkey % 14, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'b' END) WHEN 1 THEN concat(o_custkey % 300, ' BPM') WHEN 2 THEN concat('ABC-', 100 + o_custkey % 900) WHEN 3 THEN concat('VOL', 100 + o_custkey % 900) WHEN 4 THEN concat('', o_custkey % 300) WHEN 5 THEN concat('', 1800 + o_custkey % 400) WHEN 6 THEN concat(o_orderstatus, 'site.com') WHEN 7 THEN concat('www.', o_orderstatus) ELSE concat(o_orderstatus, '.mix') END"


@query(
    f"WITH w AS (SELECT o_orderkey, o_orderkey % 9 AS k, o_custkey AS c, {ASIDES} AS t FROM orders), n AS (SELECT *, try_cast(t AS INTEGER) AS n FROM w) "
    "SELECT o_orderkey, CASE WHEN k = 0 AND c % 14 BETWEEN 1 AND 12 THEN 'key' WHEN k = 1 AND c % 300 BETWEEN 40 AND 250 THEN 'tempo' WHEN k = 2 THEN 'catalogue' WHEN n BETWEEN 1 AND 99 THEN 'copy' WHEN n BETWEEN 100 AND 250 THEN 'tempo' WHEN n BETWEEN 1900 AND 2099 THEN 'year' END AS kind, "
    "CASE WHEN k = 0 AND c % 14 BETWEEN 1 AND 12 THEN lower(t) WHEN k = 1 AND c % 300 BETWEEN 40 AND 250 THEN (c % 300)::VARCHAR WHEN k = 2 THEN replace(t, '-', '') WHEN n BETWEEN 1 AND 250 OR n BETWEEN 1900 AND 2099 THEN t END AS value, k IN (6, 7) AS site FROM n"
)
def bracket_asides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with(spark, sf_dir, "orders", t=ASIDES).withColumn("aside", names.bracket_aside(F.col("t")))
    return rows.select("o_orderkey", "aside.kind", "aside.value", names.looks_like_site(F.col("t")).alias("site"))


@query(
    "SELECT p_partkey, replace(replace(replace(replace(replace(replace(t, '%20', ' '), '&#40;', '('), '&#x29;', ')'), '&lt;', '<'), '&quot;', '\"'), '&amp;', '&') AS html, "
    "replace(replace(replace(replace(replace(t, '&#40;', '('), '&#x29;', ')'), '&lt;', '<'), '&quot;', '\"'), '&amp;', '&') AS xml FROM (SELECT p_partkey, concat(p_name, CASE p_size % 4 WHEN 0 THEN '%20&#40;x&#x29;' WHEN 1 THEN ' &amp;' WHEN 2 THEN '&lt;&quot;&nope; & b;' ELSE '&toolongtobeone; ' END) AS t FROM part)"
)
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    t = F.concat("p_name", F.when(size == 0, "%20&#40;x&#x29;").when(size == 1, " &amp;").when(size == 2, "&lt;&quot;&nope; & b;").otherwise("&toolongtobeone; "))
    return table(spark, sf_dir, "part").select("p_partkey", names.decode_url_escapes(names.decode_entities(t)).alias("html"), names.xml_unescape(t).alias("xml"))


#: What a bracket holds, made from a part's brand and size, and what it says (group/kind=detail).
LABEL_FORMS = [
    ("p_brand || ' Extended Remix'", "'cut/extended,rework/remix=' || p_brand"),
    ("'Live at ' || p_brand || ' Hall'", "'rework/live=' || p_brand || ' Hall'"),
    ("'Clean / Intro + Outro'", "'cut/clean,cut/intro_outro'"),
    ("'Re-Fix by ' || p_brand", "'rework/rework=' || p_brand"),
    ("'Remastered ' || (1950 + p_size)", "'cut/remaster=' || (1950 + p_size)"),
    ("(1950 + p_size) || ' Remaster'", "'cut/remaster=' || (1950 + p_size)"),
    ("p_brand || ' Edit'", "'rework/bootleg=' || p_brand"),
    ("'Main Mix'", "NULL"),
    ("'Ana & ' || p_brand || ' Mix'", "'rework/remix=Ana & ' || p_brand"),
    ("'Dub'", "'rework/dub'"),
    ("'Instrumental Mix'", "'rework/instrumental'"),
    ("'short edit'", "'cut/short'"),
    ("p_brand || ' Clean'", "NULL"),
    ("'In-Out'", "'cut/intro_outro'"),
    ("'Quick Hit Edit'", "'cut/quick_hit'"),
    ("'Intro - Dirty'", "'cut/intro,cut/dirty'"),
    ("'V.I.P. Mix'", "'rework/vip'"),
    ("'odd words ' || p_size", "NULL"),
]


def _case(forms: list[tuple[str, ...]], k: int) -> str:
    whens = " ".join(f"WHEN {i} THEN {f[k]}" for i, f in enumerate(forms))
    return f"CASE p_partkey % {len(forms)} {whens} END"


def _listed(labels: F.Column) -> F.Column:
    one = F.transform(labels, lambda x: F.concat(x["group"], F.lit("/"), x["kind"], F.coalesce(F.concat(F.lit("="), x["detail"]), F.lit(""))))
    return F.array_join(one, ",")


@query(f"SELECT p_partkey, {_case(LABEL_FORMS, 1)} AS labels FROM part")
def version_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of brackets read from their ends backwards, with names in front, places behind and years beside them."""
    return table(spark, sf_dir, "part").select("p_partkey", _listed(releases.read_labels(F.expr(_case(LABEL_FORMS, 0)))).alias("labels"))


@query(
    "WITH k AS (SELECT p_partkey, (p_partkey % 12)::INTEGER AS n, p_size % 2 AS m FROM part) SELECT p_partkey, "
    "CASE m WHEN 0 THEN ['G#m','Ebm','Bbm','Fm','Cm','Gm','Dm','Am','Em','Bm','F#m','C#m'][n + 1] ELSE ['B','F#','Db','Ab','Eb','Bb','F','C','G','D','A','E'][n + 1] END AS standard, "
    "CASE m WHEN 0 THEN ['G#m','D#m','A#m','Fm','Cm','Gm','Dm','Am','Em','Bm','F#m','C#m'][n + 1] ELSE ['B','F#','C#','G#','D#','A#','F','C','G','D','A','E'][n + 1] END AS sharps, (n + 1) || CASE m WHEN 0 THEN 'A' ELSE 'B' END AS wheel FROM k"
)
def key_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a table's rows, written in wheel notation with a leading zero, read and formatted."""
    raw = F.concat(F.lpad((F.col("p_partkey") % 12 + 1).cast("string"), 2, "0"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("B"))
    order = music.any_key_order(raw)
    return table(spark, sf_dir, "part").select("p_partkey", *(names.key_name(order, n).alias(n) for n in ("standard", "sharps", "wheel")))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN (p_size + 1) // 2 END AS stars, CASE WHEN p_partkey % 8 BETWEEN 1 AND 5 THEN p_partkey % 8 * 2 END AS energy FROM part")
def energy_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.stars_for(F.col("p_size")).alias("stars"), names.energy_for_stars(F.col("p_partkey") % 8).alias("energy"))


TAGS = (
    "concat('{\"id3v2\":[{\"key\":\"', CASE p_size % 3 WHEN 0 THEN 'TSRC' WHEN 1 THEN 'TIT2' ELSE 'TXXX:ISRC' END, '\",\"value\":{\"type\":\"text\",\"text\":\"US-ABC-', 1000000 + p_partkey % 1000, '\"}},{\"key\":\"',"
    " CASE WHEN p_size % 2 = 0 THEN 'APIC' ELSE 'APICX' END, '\",\"value\":{\"type\":\"binary\",\"len\":', p_size % 5, '}}]}')"
)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN '' ELSE 'USABC' || (1000000 + p_partkey % 1000) END AS isrcs, p_partkey % 7 <> 0 AND NOT (p_size % 2 = 0 AND p_size % 5 > 0) AS no_cover FROM part")
def tag_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _with(spark, sf_dir, "part", tags=TAGS)
    read = F.when(F.col("p_partkey") % 7 != 0, F.col("tags"))
    return part.select("p_partkey", F.array_join(names.isrcs_in(F.col("tags")), ",").alias("isrcs"), names.no_cover(read).alias("no_cover"))


@query(
    "WITH c AS (SELECT list_sort([p_size * 1.0, 10.0, 20.0, 20.0, 30.0, 45.5]) AS c, p_partkey, (p_partkey % 60)::DOUBLE AS x FROM part), "
    "n AS (SELECT *, len(list_filter(c, lambda v: v < x)) AS below, len(list_filter(c, lambda v: v <= x)) AS upto FROM c) "
    "SELECT p_partkey, least(greatest(floor(CASE WHEN below < upto THEN (below + upto - 1) / 2 WHEN below = 0 THEN 0 WHEN below = 6 THEN 5 ELSE below - 1 + (x - c[below]) / (c[below + 1] - c[below]) END + 0.5), 0), 100)::INTEGER AS percentile FROM n"
)
def percentile_of_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.array_sort(F.array(F.col("p_size") * 1.0, *(F.lit(x) for x in (10.0, 20.0, 20.0, 30.0, 45.5))))
    return table(spark, sf_dir, "part").select("p_partkey", names.percentile_of(cuts, (F.col("p_partkey") % 60).cast("double")).alias("percentile"))


@query(
    "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '/music/' || p_brand || '/a.mp3' WHEN 1 THEN '/base/' || p_brand || '.mp3' WHEN 2 THEN 'E:/' || p_brand || '/b.mp3' WHEN 3 THEN '//srv/share/' || p_brand WHEN 4 THEN NULL ELSE '/' || p_brand END AS path FROM part"
)
def absolute_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, b = F.col("p_size") % 6, F.col("p_brand")
    raw = F.when(k == 0, F.concat(F.lit("/music/x/../"), b, F.lit("/./a.mp3"))).when(k == 1, F.concat(F.lit("sub\\..\\"), b, F.lit(".mp3"))).when(k == 2, F.concat(F.lit("E:\\"), b, F.lit("\\b.mp3")))
    raw = raw.when(k == 3, F.concat(F.lit("//srv/share/x/../"), b)).when(k == 4, F.concat(F.lit("E:/../"), b)).otherwise(F.concat(F.lit("/"), b))
    return table(spark, sf_dir, "part").select("p_partkey", names.absolute_path(raw, F.lit("/base\\")).alias("path"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey + 0.5 WHEN 1 THEN -o_custkey::DOUBLE WHEN 2 THEN NULL ELSE 0.25 END AS number, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'a' || (o_custkey % 3) || ' b' END AS note, o_custkey % 3 = 0 AS blank, "
    "CASE WHEN o_custkey % 2 = 0 THEN 'f' ELSE 'a' || o_custkey END AS content FROM orders"
)
def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    number = F.when(k == 0, F.concat(c, F.lit(".5"))).when(k == 1, F.concat(F.lit("-"), c, F.lit("."))).when(k == 2, F.concat(c, F.lit("e3"))).otherwise(".25")
    note = F.when(F.col("o_custkey") % 3 == 0, " \t ").otherwise(F.concat(F.lit(" a"), (F.col("o_custkey") % 3).cast("string"), F.lit("\nb\t")))
    audio = F.when(F.col("o_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("a"), c))
    blank = F.when(F.col("o_custkey") % 3 == 0, " ").otherwise("x")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", names.decimal(number).alias("number"), names.tidy_note(note).alias("note"), names.is_blank(blank).alias("blank"), names.content_key(audio, F.lit("f")).alias("content")
    )


@query(
    "WITH p AS (SELECT o_orderkey, list(least(greatest(l_discount * 20 - 0.5, 0), 1) ORDER BY l_linenumber, l_extendedprice) AS a, list(least(greatest(l_quantity / 4 - 1, 1), 10) ORDER BY l_linenumber, l_extendedprice) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), "
    "r AS (SELECT o_orderkey, unnest(a) AS a, unnest(e) AS e, generate_subscripts(a, 1) AS i FROM p), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY o_orderkey, a ORDER BY i DESC) = 1) "
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY a) - 1 AS place, a AS at, e AS energy FROM l"
)
def tidy_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(F.col("l_linenumber").alias("i"), F.col("l_extendedprice").alias("k"), (F.col("l_discount") * 20 - 0.5).alias("at"), (F.col("l_quantity") / 4 - 1).alias("energy"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    return rows.select("o_orderkey", F.posexplode(names.tidy_target(F.col("points"))).alias("place", "p")).select("o_orderkey", "place", "p.at", "p.energy")



#: A file's name made from a part, and how it reads: artist, title, labels, labels that may be the title's, asides, unknown.
NAME_FORMS = [
    ("'01. ' || p_brand || ' - ' || p_name || ' (Extended Mix).mp3'", "p_brand", "p_name", "'cut/extended'", "''", "''", "''"),
    ("p_brand || ' & Else feat. Other - ' || p_name || ' [8A] (' || p_brand || ' Remix (Clean))'", "p_brand || ' & Else feat. Other'", "p_name", "'rework/remix=' || p_brand || ',cut/clean'", "''", "''", "'8A'"),
    ("p_brand || '  &#45; ' || p_name || ' (ft. Other) [124 BPM]'", "p_brand", "p_name", "''", "''", "'tempo:124'", "''"),
    ("'site.com - ' || p_brand || ' – ' || p_name || ' (www.site.com) 【Radio Edit】'", "p_brand", "p_name", "'cut/radio_edit'", "''", "''", "''"),
    ("p_brand || ' - ' || p_name || ' (odd words) (2)'", "p_brand", "p_name", "''", "''", "''", "'odd words,2'"),
    ("p_brand || ' - ' || p_name || ' - ' || p_brand || ' Flip - Dirty.flac'", "p_brand", "p_name", "'rework/flip=' || p_brand || ',cut/dirty'", "''", "''", "''"),
    ("p_brand || ' - ' || p_name || ' Extended Mix'", "p_brand", "p_name || ' Extended Mix'", "''", "'cut/extended'", "''", "''"),
    ("p_brand || ' - ' || p_name || ' (Dub [Intro'", "p_brand", "p_name", "'rework/dub,cut/intro'", "''", "''", "''"),
    ("p_name || '.wav'", "NULL", "p_name", "''", "''", "''", "''"),
    ("p_brand || ' - (dirty) ' || p_name || ' (1) [FLAC 320kbps]'", "p_brand", "'(dirty) ' || p_name", "''", "''", "'copy:1'", "''"),
]


@query(f"SELECT p_partkey, {', '.join(f'{_case(NAME_FORMS, k + 1)} AS {c}' for k, c in enumerate(('artist', 'title', 'labels', 'maybe', 'asides', 'unknown')))} FROM part")
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with folders, numbers, nested and open brackets, segments and sites, read whole."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_case(NAME_FORMS, 0)).alias("name"))
    rows = releases.each_once(rows, ["name"], lambda names: releases.parse_releases(names, F.col("name"), "n"))
    asides = F.array_join(F.transform("n.asides", lambda a: F.concat_ws(":", a["kind"], a["value"])), ",")
    cells = [_listed(F.col("n.labels")).alias("labels"), _listed(F.col("n.maybe")).alias("maybe"), asides.alias("asides"), F.array_join("n.unknown", ",").alias("unknown")]
    return rows.select("p_partkey", "n.artist", "n.title", *cells)


#: Two names of a part and how they relate.
RELATION_FORMS = [
    ("p_brand || ' - ' || p_name", "upper(p_brand) || ' & Else - ' || upper(p_name) || ' (Original Mix)'", "'same'"),
    ("p_brand || ' - ' || p_name || ' (Clean)'", "p_brand || ' - ' || p_name || ' [Dirty]'", "'cut'"),
    ("p_brand || ' - ' || p_name || ' (Dub)'", "p_brand || ' - ' || p_name", "'rework'"),
    ("p_brand || ' - ' || p_name || ' (Ana Remix)'", "p_brand || ' - ' || p_name || ' - Ana''s Remix'", "'same'"),
    ("p_brand || ' - ' || p_name || ' (Ana Remix)'", "p_brand || ' - ' || p_name || ' (Bo Remix)'", "'rework'"),
    ("p_brand || ' - ' || p_name || ' (Ana Remix)'", "p_brand || ' - ' || p_name || ' (Remix)'", "'unclear'"),
    ("p_brand || ' - ' || p_name || ' Extended Mix'", "p_brand || ' - ' || p_name || ' (Extended Mix)'", "'same'"),
    ("p_brand || ' - ' || p_name || ' (2009 Remaster)'", "p_brand || ' - ' || p_name || ' (Remastered 2011)'", "'cut'"),
    ("p_brand || ' - ' || p_name", "'Nobody - ' || p_name", "'artists'"),
    ("p_brand || ' - ' || p_name", "p_brand || ' - Other'", "'title'"),
    ("p_brand || ' - ' || p_name || ' x Other'", "p_brand || ' - Other'", "'mashup'"),
    ("p_brand || ' - ' || p_name || ' (odd words)'", "p_brand || ' - ' || p_name", "'unclear'"),
    ("p_brand || ' - ' || p_name || ' [8A]'", "p_brand || ' - ' || p_name || ' [9A]'", "'unclear'"),
    ("p_brand || ' - ' || p_name || ' (1)'", "p_brand || ' - ' || p_name || ' (2)'", "'same'"),
]


@query(f"SELECT p_partkey, {_case(RELATION_FORMS, 2)} AS relation FROM part")
def name_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", *(F.expr(_case(RELATION_FORMS, k)).alias(c) for k, c in enumerate(("one", "other"))))

    def related(pairs: DataFrame) -> DataFrame:
        parsed = releases.parse_releases(releases.parse_releases(pairs, F.col("one"), "a"), F.col("other"), "b")
        return releases.relate(parsed, "a", "b").select("one", "other", "relation")

    return releases.each_once(rows, ["one", "other"], related).select("p_partkey", "relation")

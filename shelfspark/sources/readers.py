"""Readers of collections, sessions and wish lists, and writers of collections, through Spark's own formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import text

TRACK = """_TrackID long, _Name string, _Artist string, _Album string, _Genre string, _TotalTime int, _AverageBpm double, _Tonality string,
_Rating string, _Comments string, _Location string, _Kind string,
TEMPO array<struct<_Inizio:double,_Bpm:double,_Metro:string,_Battito:int>>,
POSITION_MARK array<struct<_Name:string,_Type:int,_Start:double,_End:double,_Num:int,_Red:int,_Green:int,_Blue:int>>"""
NODE = "_Type int, _Name string, _KeyType int, TRACK array<struct<_Key:string>>"


def collection_xml(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a collection export: typed fields, beat grid and cues. Entries of playlists, which have a Key, are no tracks.

    Read from one "<TRACK" to the next, so that Spark splits a file of any size, which its
    XML source does not. Tags in comments count as tags.
    """
    tag = r"""^[\s/>](?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
    rows = spark.read.option("lineSep", "<TRACK").text(path).where(F.col("value").rlike(r"^\s") & F.regexp_extract("value", tag, 0).rlike(r"\sTrackID\s*="))
    alone = F.regexp_extract("value", tag + "(?<=/)>", 0)
    whole = F.concat(F.lit("<TRACK"), F.when(alone != "", alone).otherwise(F.regexp_extract("value", r"(?s)^.*?</TRACK\s*>", 0)))
    rows = rows.select(F.from_xml(whole, TRACK, {"mode": "PERMISSIVE"}).alias("x")).select("x.*").where("_TrackID is not null")
    return rows.select(*(F.col(f"`{c}`").alias(c.lstrip("_").lower()) for c in rows.columns)).withColumn("path", text.location_decode(F.col("location")))


def playlist_xml(spark: SparkSession, path: str) -> DataFrame:
    """(name, position, key): the entries of the playlists of a collection export, in order."""
    rows = spark.read.format("xml").option("rowTag", "NODE").schema(NODE).load(path).where("_Type = 1")
    return rows.select(F.col("_Name").alias("name"), F.posexplode("TRACK").alias("position", "t")).select("name", "position", F.col("t._Key").alias("key"))


def m3u8_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, seconds, artist, title, path): plays of session files, in order; relative paths as written."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    rows = files.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")).alias("line", "x"))
    before = F.lag("x").over(Window.partitionBy("file").orderBy("line"))
    info = F.regexp_extract("info", r"^#EXTINF:\s*-?\d+\s*,(.*)$", 1)
    rows = rows.where("trim(x) <> ''").withColumn("info", F.coalesce(before, F.lit(""))).where("not startswith(x, '#')")
    place = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return rows.select(
        "file", place.alias("position"), F.regexp_extract("info", r"^#EXTINF:\s*(-?\d+)", 1).try_cast("int").alias("seconds"), text.split_artist_title(info).alias("t"), F.trim("x").alias("path")
    ).select("file", "position", "seconds", F.nullif("t.artist", F.lit("")).alias("artist"), F.nullif("t.title", F.lit("")).alias("title"), "path")


# Header names of wish lists, the most telling first.
HEADERS = {
    "artist": ("artist name(s)", "artist names", "artist name", "artists", "artist"),
    "title": ("track name", "track title", "title", "song name", "song", "track", "name"),
    "version": ("version", "mix"),
    "isrc": ("isrc",),
}


def wish_csv(spark: SparkSession, path: str) -> DataFrame:
    """(artist, title, version, isrc) of a CSV file whose header names are known ones, in any case."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.strip().lstrip("﻿").lower(): c for c in rows.columns}
    pick = lambda names: next((F.trim(F.col(f"`{have[n]}`")) for n in names if n in have), F.lit(None).cast("string"))
    out = rows.select(*(pick(HEADERS[c]).alias(c) for c in ("artist", "title", "version", "isrc")))
    return out.withColumn("isrc", text.isrc(F.col("isrc"))).where("coalesce(title, '') <> ''")


def pasted(lines: DataFrame, column: str = "value") -> DataFrame:
    """(artist, title, version) of free lines: numbers and times in front are dropped."""
    clean = text.collapse_spaces(text.strip_time(text.strip_number(F.col(column))))
    rows = lines.select(text.split_artist_title(clean).alias("t")).where("t.title <> ''")
    return rows.select("t.artist", text.split_version(F.col("t.title")).alias("v")).select("artist", "v.title", "v.version")


def write_collection(rows: DataFrame, path: str) -> None:
    """Write tracks (columns as the attributes' names) as XML that ``collection_xml`` reads back."""
    named = rows.select(*(F.col(c).alias(f"_{c}") for c in rows.columns))
    named.write.format("xml").option("rootTag", "COLLECTION").option("rowTag", "TRACK").mode("errorifexists").save(path)


def playlist_lines(entries: DataFrame, by: str = "playlist_id") -> DataFrame:
    """(playlist, xml): each list as one escaped element, entries in order."""
    name = text.xml_escape(F.col(by).cast("string"))
    keys = F.transform(F.sort_array(F.collect_list(F.struct("position", "recording_id"))), lambda e: F.concat(F.lit('<TRACK Key="'), e["recording_id"].cast("string"), F.lit('"/>')))
    rows = entries.groupBy(by).agg(keys.alias("keys"))
    return rows.select(F.col(by), F.concat(F.lit('<NODE Name="'), name, F.lit('" Type="1" Entries="'), F.size("keys").cast("string"), F.lit('">'), F.array_join("keys", ""), F.lit("</NODE>")).alias("xml"))

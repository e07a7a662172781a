"""The whole derived row of each track, kept in a table that the list queries read."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import music, text
from shelfspark.operators import derive, genres
from shelfspark.sources.keyed_table import KeyedTable

#: Sources of tempo and key, and of energy, the first that has a value wins; estimates never show as energy.
VALUE_ORDER = ("user", "external", "tag", "local")
ENERGY_ORDER = ("user", "mik")
ROW = (
    "recording_id long, flags long, format string, file long, title string, artist string, genre string, title_key string, artist_key string, genre_key string, file_key string, folder_key string, "
    "bpm double, key_order int, time_ms long, rating int, energy int, added_at timestamp, genre_group string, genre_node long, text_hash long"
)


def _first(values: DataFrame, field: str, order: tuple[str, ...]) -> DataFrame:
    """(track, value) of a field by the first source in order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    rows = values.where((F.col("field") == field) & (rank > 0) & F.col("value").isNotNull())
    return rows.groupBy("track").agg(F.min_by("value", F.struct(rank, "value")).alias(field))


def _tag(fields: Column, name: str) -> Column:
    return F.get(F.filter(fields, lambda x: x["field"] == name), F.lit(0))["value"]


def _key(c: str) -> Column:
    return F.when(F.trim(c) != "", text.sort_key(F.col(c)))


def full_rows(
    tracks: DataFrame, library: DataFrame, files: DataFrame, copies: DataFrame, entries: DataFrame, crates: DataFrame, values: DataFrame, nodes: DataFrame, aliases: DataFrame
) -> DataFrame:
    """One row (see ``ROW``) per ``tracks(track, created_at)``.

    ``library(track, linked, gone, added_at)``; ``files(file, root, path, format, duration_ms,
    present, verdict, stale, raw_tags)``; ``copies(track, file, role)``; ``entries(entry, file,
    probable, plays, title, artist, genre, total_s, rating)`` of the external collection;
    ``crates(track)``; ``values(track, field, source, value)`` for bpm, key and energy;
    ``nodes`` and ``aliases`` of the genre tree. Title and artist are those of the entry shown,
    else of the shown file's tags, and the title else the file's name; genre likewise.
    Every side is one row a track before it is joined.
    """
    base = derive.track_rows(tracks.select("track"), library, files, copies, entries.select("file", "probable"), crates)
    shown = base.select("track", "file")
    trusted = entries.where(~F.col("probable")).join(copies.select("track", "file").distinct(), "file").join(files.select("file", "present"), "file")
    chosen = derive.shown_entry(trusted.select("entry", "track", "file", F.coalesce("present", F.lit(False)).alias("present"), "plays"), shown)
    said = chosen.join(entries.select("entry", F.col("title").alias("e_title"), F.col("artist").alias("e_artist"), F.col("genre").alias("e_genre"), "total_s", "rating"), "entry").drop("entry")
    facts = files.select("file", "root", "path", derive.tag_fields(F.col("raw_tags")).alias("tags"))
    sides = [
        said,
        _first(values, "bpm", VALUE_ORDER).select("track", F.col("bpm").cast("double").alias("bpm")),
        _first(values, "key", VALUE_ORDER).select("track", music.any_key_order(F.col("key")).alias("key_order")),
        _first(values, "energy", ENERGY_ORDER).select("track", F.col("energy").cast("int").alias("energy")),
        library.select("track", "added_at"),
        tracks.select("track", "created_at"),
    ]
    rows = functools.reduce(lambda a, b: a.join(b, "track", "left"), sides, base.join(facts, "file", "left"))
    rows = rows.withColumns(
        {
            "title": F.coalesce(*(text.blank_to_null(c) for c in (F.col("e_title"), _tag(F.col("tags"), "title"), text.file_name_text(F.col("path")))), F.lit("")),
            "artist": F.coalesce(*(text.blank_to_null(c) for c in (F.col("e_artist"), _tag(F.col("tags"), "artist")))),
            "genre": derive.genre_of(F.lit(None).cast("string"), F.col("e_genre"), _tag(F.col("tags"), "genre")),
            "file_name": text.file_name(F.col("path")),
            "folder": F.when(F.col("path").isNotNull(), F.concat_ws("/", "root", F.nullif(text.folder_of(F.col("path")), F.lit("")))),
        }
    )
    resolved = genres.resolve(rows.where("genre IS NOT NULL").select(F.col("genre").alias("spelling")), nodes, aliases).select(F.col("spelling").alias("genre"), F.col("node").alias("genre_node"))
    rows = rows.join(resolved, "genre", "left")
    level = F.when(F.col("energy").between(1, 10), F.col("energy"))
    time = music.time_ms(F.col("total_s"), F.col("duration_ms"))
    made = {
        "recording_id": F.col("track"), "flags": F.col("flags") + music.energy_bits(level), "format": F.col("format"), "file": F.col("file"),
        "title": F.col("title"), "artist": F.col("artist"), "genre": F.col("genre"),
        "title_key": text.sort_key(F.col("title")), "artist_key": _key("artist"), "genre_key": _key("genre"), "file_key": _key("file_name"), "folder_key": _key("folder"),
        "bpm": F.col("bpm"), "key_order": F.col("key_order"), "time_ms": F.when(time > 0, time), "rating": text.stars_of(F.col("rating")), "energy": level,
        "added_at": F.coalesce("added_at", "created_at"), "genre_group": text.genre_group(F.col("genre")), "genre_node": F.col("genre_node"),
        "text_hash": F.xxhash64("title", "artist", "genre", "file_name"),
    }
    kinds = {f.split()[0]: f.split()[1] for f in ROW.split(", ")}
    return rows.select(*(v.cast(kinds[c]).alias(c) for c, v in made.items()))


def table_at(rows: DataFrame, path: str) -> KeyedTable:
    return KeyedTable(rows.sparkSession, path, ["recording_id"], ROW)

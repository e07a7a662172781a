"""The row that lists show for each track, derived from files, entries, verdicts and collections."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names, text
from shelfspark.operators import filters

# Verdicts that say that a file is bad, and where tags keep a field.
LOW_QUALITY_VERDICTS = ("broken", "truncated", "transcode", "lowBitrate")
TAG_FIELDS = {
    "TIT2": "title", "TITLE": "title", "TPE1": "artist", "ARTIST": "artist", "TALB": "album", "ALBUM": "album", "TCON": "genre", "GENRE": "genre",
    "TBPM": "bpm", "BPM": "bpm", "TKEY": "key", "INITIALKEY": "key", "TSRC": "isrc", "ISRC": "isrc", "TDRC": "year", "DATE": "year", "COMM": "comment", "COMMENT": "comment",
}


def shown_file(library: DataFrame, copies: DataFrame) -> DataFrame:
    """(track, file) of ``copies(track, file, role)``: the file that ``library(track, linked)`` links, else the best, else the lowest."""
    own = copies.groupBy("track").agg(F.min_by("file", F.struct(F.coalesce(F.col("role") != "best", F.lit(True)), F.col("file"))).alias("best"))
    both = own.join(library, "track", "full")
    return both.select("track", F.coalesce("linked", "best").alias("file"))


def low_quality(verdict: Column, stale: Column) -> Column:
    """Whether a current verdict flags a file; a stale or missing one does not."""
    return F.coalesce(verdict.isin(*LOW_QUALITY_VERDICTS) & ~stale, F.lit(False))


def genre_of(own: Column, external: Column, tag: Column) -> Column:
    return F.coalesce(*(text.blank_to_null(x) for x in (own, external, tag)))


def track_rows(tracks: DataFrame, library: DataFrame, files: DataFrame, copies: DataFrame, entries: DataFrame, crates: DataFrame) -> DataFrame:
    """One row per ``tracks(track)``: shown file, its format and length, and the flags of the list query.

    ``library(track, linked, gone)``; ``files(file, format, duration_ms, present, verdict, stale, raw_tags)``;
    ``copies(track, file, role)``; ``entries(file, probable)``; ``crates(track)``. Every input is reduced to one
    row per track or file before it is joined, so no join makes more rows than there are tracks.
    """
    shown = shown_file(library.select("track", "linked"), copies)
    trusted = entries.where(~F.col("probable")).select("file").distinct()
    external = copies.join(trusted, "file", "left_semi").select("track").distinct().withColumn("external", F.lit(True))
    crated = crates.select("track").distinct().withColumn("crated", F.lit(True))
    linked = files.select(F.col("file").alias("linked"), low_quality(F.col("verdict"), F.col("stale")).alias("low"), names.no_cover(F.col("raw_tags")).alias("no_art"), F.col("raw_tags").isNull().alias("no_tags"))
    mine = library.join(linked, "linked", "left").select("track", F.lit(True).alias("mine"), "gone", "low", "no_art", "no_tags")
    facts = files.select("file", "format", "duration_ms", "present")
    rows = tracks.join(shown, "track", "left").join(facts.withColumn("known", F.lit(True)), "file", "left")
    for side in (mine, external, crated):
        rows = rows.join(side, "track", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    has_file = yes("known")
    bits = {
        filters.IN_LIBRARY: yes("mine"),
        filters.HAS_FILE: has_file,
        filters.MISSING: ~has_file | ~yes("present") | yes("gone"),
        filters.LOW_QUALITY: yes("low"),
        filters.EXTERNAL: yes("external"),
        filters.IN_CRATE: yes("crated"),
        filters.NO_TAGS: yes("mine") & yes("no_tags"),
        filters.NO_ART: yes("no_art"),
    }
    flags = functools.reduce(lambda a, b: a + b, (x.cast("long") * bit for bit, x in bits.items()))
    return rows.select("track", F.when(has_file, F.col("file")).alias("file"), "format", "duration_ms", flags.alias("flags"))


def library_where(rows: DataFrame, library: DataFrame, files: DataFrame, condition: Column) -> DataFrame:
    """The rows whose library track exists and whose linked file's columns (null without one) meet a condition."""
    mine = library.join(files.withColumnRenamed("file", "linked"), "linked", "left").where(condition).select("track")
    return rows.join(mine, "track", "left_semi")


def changed_rows(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` that ``stored`` lacks or holds with other values; blanks compare as values."""
    cols = [c for c in new.columns if c != key]
    old = stored.select(F.col(key), F.struct(*cols).alias("old__"))
    return new.join(old, key, "left").where(~F.struct(*cols).eqNullSafe(F.col("old__"))).select(*new.columns)


def window_rows(page: DataFrame, wide: DataFrame, key: str, most: int = 500) -> DataFrame:
    """The wide rows of a page's ids, at most ``most`` of them, so the page is broadcast and the wide table only scanned."""
    return wide.join(F.broadcast(page.select(key).limit(most)), key)


def tag_fields(raw_tags: Column) -> Column:
    """array<struct<field, value>> of the text frames of nested tags whose key names a field, in the tags' order."""
    table = F.create_map(*[F.lit(x) for p in TAG_FIELDS.items() for x in p])
    frames = names._frames(raw_tags, lambda b, f: F.try_element_at(table, F.upper(f["key"])).isNotNull() & (F.trim(f["value"]["text"]) != ""))
    return F.transform(frames, lambda f: F.struct(F.try_element_at(table, F.upper(f["key"])).alias("field"), F.trim(f["value"]["text"]).alias("value")))


def tag_sources(rows: DataFrame, key: str, sources: dict[str, dict[str, str]]) -> DataFrame:
    """(key, field, value, source): every source's value that is not blank, one row each; ``sources`` maps source to field to column."""
    cells = [F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value"), F.lit(s).alias("source")) for s, fields in sources.items() for f, c in fields.items()]
    return rows.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*").where(F.trim("value") != "")


def send_values(found: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, fields): a map from field to (value, source), the first source of ``order`` that has the field."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    one = found.where(rank > 0).groupBy(key, "field").agg(F.min_by(F.struct("value", "source"), F.struct(rank, "value")).alias("v"))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "v")))).alias("fields"))


def shown_entry(entries: DataFrame, shown: DataFrame) -> DataFrame:
    """(track, entry): of ``entries(entry, track, file, present, plays)`` that on the shown file, present, most played, lowest."""
    rows = entries.join(shown.withColumnRenamed("file", "shown"), "track", "left")
    order = F.struct(F.coalesce(F.col("file") != F.col("shown"), F.lit(True)), ~F.col("present"), -F.coalesce("plays", F.lit(0)), F.col("entry"))
    return rows.groupBy("track").agg(F.min_by("entry", order).alias("entry"))


def estimated(values: DataFrame, key: str, order: list[str], own: str = "local") -> DataFrame:
    """(key, field, estimated): whether the winning source of ``values(key, field, source)`` is the engine's own estimate."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    won = values.where(rank > 0).groupBy(key, "field").agg(F.min_by("source", rank).alias("won"))
    return won.select(key, "field", (F.col("won") == own).alias("estimated"))

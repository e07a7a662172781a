"""Wishes met with tracks by parsed names, and what an external collection offers to the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names, releases, text
from shelfspark.storage import stored

# What a relation of names makes of a track, the best first.
RANKS = {"same": 3, "cut": 2, "rework": 1}
OUTCOMES = {3: "owned", 2: "otherCut", 1: "rework"}
STREAMING = "^(soundcloud|tidal|beatport|spotify|https?):"


def title_keys(parsed: str) -> Column:
    """The keys by which a parsed title is looked up: as it stands, and without label words at its end."""
    return F.array_distinct(F.filter(F.array(names.version_key(F.col(f"{parsed}.title")), names.version_key(F.col(f"{parsed}.core"))), lambda k: k != ""))


def find(wishes: DataFrame, tracks: DataFrame) -> DataFrame:
    """(wish, outcome, track, by_isrc): owned, otherCut, rework or missing, and the track that says so.

    ``wishes(wish, artist, name, isrc)``, ``tracks(track, artist, name, isrc, library)``; names
    are titles with their version. A recording code decides alone (its lowest track); else tracks
    that share an artist and a reading of the title are compared by their labels, the same
    version before another cut before a rework, library tracks first, then the lowest. Artists and
    titles are joined together, so a frequent artist makes no pairs of all its titles. Each
    different artist and name is parsed once, and each two that meet are compared once: wishes of one artist
    and name are one entry, and of the tracks of one artist and name only the first can be its answer.
    """
    own = lambda df: df.withColumn("isrc", text.isrc(F.col("isrc")))
    wishes, tracks = own(wishes), own(tracks)
    different = wishes.select("name").unionByName(tracks.select("name")).where("name IS NOT NULL").distinct()
    parsed = stored(releases.parse_releases(different, F.col("name"), "n", False), "wish-names")
    keys = parsed.select("name", title_keys("n").alias("keys"))
    codes = tracks.where("isrc IS NOT NULL").groupBy("isrc").agg(F.min("track").alias("coded"))
    artists = stored(wishes.select("artist").unionByName(tracks.select("artist")).distinct().select("artist", names.artist_keys(F.col("artist")).alias("artist_keys")), "wish-artists")
    by_artist = lambda rows: rows.where("name IS NOT NULL").join(artists, "artist").withColumn("artist_key", F.explode("artist_keys"))
    wanted = by_artist(wishes).select("wish", "artist_key", F.col("name").alias("wish_name"))
    order = F.struct((~F.coalesce("library", F.lit(False))).alias("outside"), "track")
    first = stored(by_artist(tracks).groupBy("artist_key", F.col("name").alias("track_name")).agg(F.min(order).alias("first")), "wish-tracks")
    read = lambda rows, c: rows.join(keys.withColumnRenamed("name", c), c).select("artist_key", c, F.explode("keys").alias("title_key"))
    met = read(wanted.select("artist_key", "wish_name").distinct(), "wish_name").join(read(first, "track_name"), ["artist_key", "title_key"])
    met = stored(met.select("artist_key", "wish_name", "track_name").distinct(), "wish-pairs")
    pairs = met.select("wish_name", "track_name").distinct()
    for c in ("wish", "track"):
        pairs = pairs.join(parsed.select(F.col("name").alias(f"{c}_name"), F.col("n").alias(c)), f"{c}_name")
    related = releases.relate(pairs, "wish", "track")
    rank = F.coalesce(*(F.when(F.col("relation") == r, k) for r, k in RANKS.items()))
    ranked = met.join(related.select("wish_name", "track_name", rank.alias("rank")).where("rank IS NOT NULL"), ["wish_name", "track_name"]).join(first, ["artist_key", "track_name"])
    answers = ranked.groupBy("artist_key", "wish_name").agg(F.min(F.struct((-F.col("rank")).alias("worse"), "first.outside", "first.track", "rank")).alias("x"))
    best = wanted.join(answers, ["artist_key", "wish_name"]).groupBy("wish").agg(F.min("x").alias("x"))
    found = wishes.select("wish", "isrc").join(codes, "isrc", "left").join(best.select("wish", F.col("x.track").alias("named"), F.col("x.rank").alias("rank")), "wish", "left")
    outcome = F.when(F.col("coded").isNotNull(), "owned")
    for k, name in OUTCOMES.items():
        outcome = outcome.when(F.col("rank") == k, name)
    return found.select("wish", outcome.otherwise("missing").alias("outcome"), F.coalesce("coded", "named").alias("track"), F.col("coded").isNotNull().alias("by_isrc"))


def offered(entries: DataFrame, copies: DataFrame, library: DataFrame, removed: DataFrame, files: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(state, n): what becomes of an external collection's entries: toAdd, inLibrary, missing, unconfirmed.

    ``entries(entry, location, file, probable, playlists)``, ``copies(track, file)``,
    ``library(track)``, ``removed(track)`` what the user took out, ``files(file, present)``;
    ``chosen(path)`` narrows to entries in one of these playlists. Entries that wait are counted
    one by one, tracks once, and a trusted match is never held back for a doubtful one.
    """
    rows = entries
    if chosen is not None:
        named = rows.select("entry", F.explode("playlists").alias("path")).join(chosen.select("path").distinct(), "path", "left_semi")
        rows = rows.join(named.select("entry").distinct(), "entry", "left_semi")
    streaming = F.coalesce(F.col("location").rlike(STREAMING), F.lit(False))
    probable = F.coalesce("probable", F.lit(False))
    waiting = rows.select(F.when(F.col("file").isNull() & ~streaming, "missing").when(F.col("file").isNotNull() & probable, "unconfirmed").alias("state")).where("state IS NOT NULL")
    trusted = rows.where(F.col("file").isNotNull() & ~probable).select("file").join(copies.select("track", "file").distinct(), "file")
    there = trusted.join(files.select("file", "present"), "file", "left").groupBy("track").agg(F.max(F.coalesce("present", F.lit(False))).alias("there"))
    there = there.join(removed.select("track"), "track", "left_anti")
    mine = library.select("track", F.lit(True).alias("mine")).distinct()
    state = F.when(F.col("mine"), "inLibrary").when(F.col("there"), "toAdd").otherwise("missing")
    return waiting.unionByName(there.join(mine, "track", "left").select(state.alias("state"))).groupBy("state").agg(F.count("*").alias("n"))

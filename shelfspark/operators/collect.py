"""Summaries of sessions, wish lists and libraries, learning inputs, and what is sent elsewhere."""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators import filters

#: Reasons that a suggestion may carry, and the parameters that each needs.
REASONS = {"sameKey": ("key",), "nearTempo": ("gap",), "sharedTags": ("count",), "playedTogether": ("times",)}


def play_counts(plays: DataFrame, session: str = "session") -> DataFrame:
    """(session, started, plays, matched): sessions with the numbers of plays and of those matched to a track, the newest first."""
    rows = plays.groupBy(session).agg(F.min("at").alias("started"), F.count("*").alias("plays"), F.count("track").alias("matched"))
    return rows.orderBy(F.desc("started"), session)


def wish_summary(items: DataFrame) -> DataFrame:
    """(list, items, owned, missing) of ``items(list, track, acquired)``."""
    have = F.col("track").isNotNull() | F.coalesce("acquired", F.lit(False))
    return items.groupBy("list").agg(F.count("*").alias("items"), F.sum(have.cast("long")).alias("owned"), F.sum((~have).cast("long")).alias("missing"))


def weighted_score(segments: DataFrame, key: str) -> DataFrame:
    """(key, score): the mean of segments' scores, each weighing its length; null if all lengths are 0."""
    return segments.groupBy(key).agg((F.sum(F.col("score") * F.col("items")) / F.nullif(F.sum("items"), F.lit(0))).alias("score"))


def nested_frames(frames: DataFrame, key: str) -> DataFrame:
    """(key, digest): JSON of each block's values, in order, by block name."""
    blocks = frames.groupBy(key, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("v"))
    whole = F.map_from_entries(F.array_sort(F.collect_list(F.struct("block", "v"))))
    return blocks.groupBy(key).agg(F.to_json(whole).alias("digest"))


def user_energy(values: DataFrame) -> DataFrame:
    """How many tracks have an energy that the user gave."""
    return values.where("source = 'user' AND energy IS NOT NULL").agg(F.countDistinct("track").alias("n"))


def stamp(library: DataFrame) -> DataFrame:
    """Number of tracks and a stamp that a change of any row moves, whatever the rows' order: a sum of the rows' digests, so repeated rows count."""
    digest = F.md5(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u001e")) for c in library.columns)))
    total = F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)"))
    return library.agg(F.count("*").alias("tracks"), total.cast("string").alias("stamp"))


def embedded(files: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Files with the vector of their present content by one model: an older content's or another model's vector is none."""
    own = vectors.where(F.col("model") == model).drop("model")
    return files.join(own, ["file", "audio_hash"])


def training_set(library: DataFrame, genres: DataFrame, files: DataFrame, vectors: DataFrame, model: str, least: int) -> DataFrame:
    """(track, node, file, audio_hash, vector) of library tracks with a genre that ``least`` of them have, and a vector."""
    rows = embedded(library.join(genres, "track").join(files, "track"), vectors, model)
    enough = rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("node")
    return rows.join(enough, "node", "left_semi")


def signature(rows: DataFrame, *columns: str) -> DataFrame:
    """A digest of what a model is learned from, equal exactly if the rows are; rows are digested first, so nothing is gathered.

    The sums of two 64-bit halves of the rows' SHA-256 do not hang on order and count repeated rows.
    """
    digest = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u001e")) for c in columns)), 256)
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)"))
    parts = rows.agg(F.count("*").alias("n"), half(1).alias("a"), half(16).alias("b"))
    return parts.select(F.sha2(F.concat_ws("/", "n", "a", "b"), 256).alias("signature"))


def candidates(library: DataFrame, genres: DataFrame, target: int) -> DataFrame:
    """Every library track but the target, with its genre if it has one."""
    return library.where(F.col("track") != target).join(genres, "track", "left")


def tags_in_common(tags: DataFrame, target: int) -> DataFrame:
    """(track, n): how many of the target's tags each other track has; the target's tags are semi-joined, not collected."""
    mine = tags.where(F.col("track") == target).select("tag").distinct()
    rows = tags.where(F.col("track") != target).select("track", "tag").distinct()
    return rows.join(mine, "tag", "left_semi").groupBy("track").agg(F.count("*").alias("n"))


def evaluated(rows: DataFrame, rules: dict[int, dict[str, Any]]) -> DataFrame:
    """(crate, track): the library tracks of every smart collection, all rules tested in one scan."""
    hits = F.array(*(F.when(filters.rule(r), F.lit(k)) for k, r in sorted(rules.items())))
    mine = rows.where(F.col("flags").bitwiseAND(filters.IN_LIBRARY) != 0)
    return mine.select(F.explode(F.array_compact(hits)).alias("crate"), F.col("recording_id").alias("track"))


def crate_tree(static: DataFrame, smart: DataFrame, names_of: DataFrame) -> DataFrame:
    """(crate, name, tracks): one playlist per collection, static ones in their order and smart ones by track; empty ones included."""
    rows = static.select("crate", "place", "track").unionByName(smart.select("crate", F.col("track").alias("place"), "track"))
    lists = rows.groupBy("crate").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "track"))), lambda x: x["track"]).alias("tracks"))
    none = F.array().cast("array<bigint>")
    return names_of.join(lists, "crate", "left").select("crate", "name", F.coalesce(F.col("tracks").cast("array<bigint>"), none).alias("tracks"))


def tag_playlists(tags: DataFrame) -> DataFrame:
    """(tag, tracks): one playlist per tag, each track once."""
    return tags.groupBy("tag").agg(F.array_sort(F.collect_set("track")).alias("tracks"))


def record_send(base: DataFrame, sent: DataFrame, keys: tuple[str, str] = ("track", "field")) -> DataFrame:
    """The values last sent, with those of a send put in their fields' places and the old ones kept as ``replaced``."""
    was = base.select(*keys, F.col("value").alias("was"), F.col("replaced").alias("was_replaced"))
    now = sent.select(*keys, F.col("value").alias("now"), F.lit(True).alias("sent"))
    both = was.join(now, list(keys), "full")
    moved = F.col("sent") & ~F.col("now").eqNullSafe(F.col("was"))
    return both.select(*keys, F.when(F.col("sent"), F.col("now")).otherwise(F.col("was")).alias("value"), F.when(moved, F.col("was")).otherwise(F.col("was_replaced")).alias("replaced"))


def attach(analyses: DataFrame, entries: DataFrame) -> DataFrame:
    """Analyses by (track, source) with the external entry's tempo and key put in, and those of tracks without an entry taken out."""
    own = analyses.where("source <> 'external'")
    shown = entries.where("bpm IS NOT NULL OR key IS NOT NULL").select("track", F.lit("external").alias("source"), "bpm", "key")
    return own.select("track", "source", "bpm", "key").unionByName(shown)


def in_chosen(playlists: Column, chosen: list[str]) -> Column:
    """Whether a JSON array of paths holds one of the chosen; false for null or broken JSON."""
    return F.coalesce(F.arrays_overlap(F.from_json(playlists, "array<string>"), F.array(*map(F.lit, chosen))), F.lit(False))


def with_signals(score: Column, weight: Column, signals: list[tuple[Column, Column]]) -> Column:
    """A weighted score with further (weight, fitness) pairs; one without a number, or outside 0 to 1, or without weight counts nothing."""
    num, den = score * weight, weight
    for w, f in signals:
        ok = F.coalesce((w > 0) & ~F.isnan(w) & f.between(0, 1) & ~F.isnan(f), F.lit(False))
        num, den = num + F.when(ok, w * f).otherwise(0.0), den + F.when(ok, w).otherwise(0.0)
    return F.when(den > 0, num / den)


def reason(key: str, source: str, **params: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.create_map(*[x for k, v in params.items() for x in (F.lit(k), v.cast("string"))]).alias("params"), F.lit(source).alias("source"))


def reason_valid(r: Column) -> Column:
    """Whether a reason is a known one and has all parameters that it needs, none of them null."""
    out = F.lit(False)
    for key, needed in REASONS.items():
        has = functools.reduce(lambda a, b: a & b, [F.try_element_at(r["params"], F.lit(p)).isNotNull() for p in needed])
        out = F.when(r["key"] == key, has).otherwise(out)
    return F.coalesce(out, F.lit(False))


def labels_apart(a: Column, b: Column) -> Column:
    """struct(only_a, only_b): what only one of two label lists has."""
    return F.struct(F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b"))


def name_buckets(files: DataFrame, most: int = 50) -> DataFrame:
    """(a, b): files of one title; in a title of more than ``most`` files only those of one artist too, and titles with more than ``most`` of one artist are left to other evidence, as the rule says."""
    sizes = files.groupBy("title").agg(F.count("*").alias("n"))
    rows = files.join(sizes, "title").withColumn("bucket", F.when(F.col("n") <= most, F.struct("title", F.lit(None).cast("string").alias("artist"))).otherwise(F.struct("title", "artist")))
    small = rows.groupBy("bucket").agg(F.count("*").alias("m")).where((F.col("m") <= most) & (F.col("m") > 1))
    rows = rows.join(small, "bucket").select("bucket", "file")
    pairs = rows.toDF("bucket", "a").join(rows.toDF("bucket", "b"), "bucket")
    return pairs.where("a < b").select("a", "b").distinct()

"""Review queues, hidden rows, wish lists, offers, dues and the choice of a track's best file."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts from best to worst; a missing one counts as unchecked.
VERDICTS = ("ok", "unchecked", "flagged", "truncated", "broken")


def shown_tracks(files: DataFrame, track: str, hidden_reason: str) -> DataFrame:
    """(track, shown): a track is shown if some file of it has no reason to be hidden."""
    return files.groupBy(track).agg(F.bool_or(F.col(hidden_reason).isNull()).alias("shown"))


def links_of(links: DataFrame, mine: DataFrame, track: str) -> DataFrame:
    """(track, other, kind): links of some tracks, whichever end they stand at, as a union of two equi-joins."""
    ends = links.select(F.col("a").alias(track), F.col("b").alias("other"), "kind")
    ends = ends.unionByName(links.select(F.col("b").alias(track), F.col("a").alias("other"), "kind"))
    return ends.join(mine.select(track).distinct(), track, "left_semi")


def review_counts(queues: dict[str, DataFrame], groups: dict[str, str]) -> DataFrame:
    """(grp, kind, n): open items per kind, per group (kind null) and over all (both null)."""
    rows = [q.select(F.lit(groups[k]).alias("grp"), F.lit(k).alias("kind")) for k, q in queues.items()]
    return functools.reduce(DataFrame.unionByName, rows).rollup("grp", "kind").agg(F.count("*").alias("n"))


def grouped_missing(rows: DataFrame, folder: str, item: str) -> DataFrame:
    """(folder, n, first): missing items by their last known folder, with the first in order."""
    return rows.groupBy(folder).agg(F.count("*").alias("n"), F.min(item).alias("first"))


def latest(*times: tuple[DataFrame, str]) -> DataFrame:
    """(at): the latest time in several tables."""
    return functools.reduce(DataFrame.unionByName, [d.agg(F.max(c).alias("at")) for d, c in times]).agg(F.max("at").alias("at"))


def due(files: DataFrame, ledger: DataFrame, key: str, stamps: list[str], version: int) -> DataFrame:
    """Keys that a stage still has to do: no outcome of this version with the same stamps, nulls being equal."""
    done = ledger.where(F.col("version") == version).select(F.col(key).alias("k__"), *(F.col(s).alias(f"{s}__") for s in stamps))
    same = F.col(key) == F.col("k__")
    for s in stamps:
        same &= F.col(s).eqNullSafe(F.col(f"{s}__"))
    return files.join(done, same, "left_anti").select(key)


def wish_match(wishes: DataFrame, tracks: DataFrame) -> DataFrame:
    """(wish, outcome, track): the best match of each wish by ISRC, then artist and title with or without the version.

    Both have isrc, artist, title and version; tracks also track and rework.
    """
    codes = tracks.where("isrc IS NOT NULL").groupBy("isrc").agg(F.min("track").alias("track"))
    by_code = wishes.join(codes, "isrc").select("wish", F.lit(0).alias("rank"), "track", F.lit("owned").alias("outcome"))
    # wishes and tracks alike in all that is compared are one entry each, tracks stood for by the lowest
    first = tracks.where("artist IS NOT NULL AND title IS NOT NULL").groupBy("artist", "title", F.col("version").alias("t_version"), "rework").agg(F.min("track").alias("track"))
    named = wishes.select("artist", "title", "version").distinct().join(first, ["artist", "title"])
    same = F.col("version").eqNullSafe(F.col("t_version"))
    rank = F.when(same, 1).when(~F.col("rework"), 2).otherwise(3)
    outcome = F.when(same, "owned").when(~F.col("rework"), "otherCut").otherwise("rework")
    answers = named.groupBy("artist", "title", F.col("version").alias("version__")).agg(F.min(F.struct(rank.alias("rank"), "track", outcome.alias("outcome"))).alias("x"))
    by_name = wishes.join(answers, ["artist", "title"]).where(F.col("version").eqNullSafe(F.col("version__"))).select("wish", "x.rank", "x.track", "x.outcome")
    best = by_code.unionByName(by_name).groupBy("wish").agg(F.min(F.struct("rank", "track", "outcome")).alias("best"))
    return wishes.select("wish").join(best, "wish", "left").select("wish", F.coalesce("best.outcome", F.lit("missing")).alias("outcome"), F.col("best.track").alias("track"))


def membership_merge(app: DataFrame, external: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, decision): what becomes of each membership that one of three sides has."""
    sides = [d.select(*keys).distinct().withColumn(n, F.lit(True)) for n, d in (("app", app), ("ext", external), ("base", base))]
    rows = sides[0].join(sides[1], keys, "full").join(sides[2], keys, "full").fillna(False, ["app", "ext", "base"])
    decision = (
        F.when(F.col("app") == F.col("ext"), "same")
        .when(F.col("app") != F.col("base"), F.when(F.col("app"), "add there").otherwise("remove there"))
        .otherwise(F.when(F.col("ext"), "add here").otherwise("remove here"))
    )
    return rows.select(*keys, decision.alias("decision"))


def lone_copies(files: DataFrame, entries: DataFrame, content: str) -> DataFrame:
    """(content, file, entry): contents with exactly one file and one entry."""
    one = lambda d, c: d.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(c).alias(c), F.count("*").alias("n")).where("n = 1").drop("n")
    return one(files, "file").join(one(entries, "entry"), content)


def offer_kind(track: Column, file: Column, confirmed: Column) -> Column:
    return F.when(track.isNotNull(), "inLibrary").when(file.isNull(), "missing").when(~confirmed, "unconfirmed").otherwise("toAdd")


def best_file_order() -> list[Column]:
    """The order of a track's files, best first, over columns chosen, present, verdict, playable, cutoff_hz, decode_errors,
    format_rank, tags_filled, has_art, known, place and file. A cutoff counts in whole kHz, all from 19 up being equal,
    and a measured one before none.
    """
    worse = F.array_position(F.array(*map(F.lit, VERDICTS)), F.coalesce("verdict", F.lit("unchecked")))
    known = F.when(F.col("known") == "trusted", 0).when(F.col("known") == "probable", 1).otherwise(2)
    cutoff = F.coalesce(F.least(F.floor(F.col("cutoff_hz") / 1000), F.lit(19)), F.lit(-1))
    return [
        ~F.col("chosen"), ~F.col("present"), worse, ~F.col("playable"), -cutoff, F.col("decode_errors"), F.col("format_rank"),
        -F.col("tags_filled"), ~F.col("has_art"), known, F.col("place"), F.col("file"),
    ]


def tags_filled(*fields: Column) -> Column:
    return F.size(F.array_compact(F.array(*(F.when(F.trim(f) != "", F.lit(1)) for f in fields))))

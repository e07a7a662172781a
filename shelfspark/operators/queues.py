"""Work that is due as tables: review queues, change marks, arrivals, and what an operation touched."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.storage import stored

#: Stands for all library tracks in a table of marks.
EVERY = -1


def version_doubts(pairs: DataFrame, copies: DataFrame, library: DataFrame) -> DataFrame:
    """(a, b): open pairs of files, as pairs of their different tracks, the lower first, of which one is in the library."""
    of = lambda side: copies.select(F.col("file").alias(f"file_{side}"), F.col("track").alias(f"track_{side}"))
    rows = pairs.join(of("a"), "file_a").join(of("b"), "file_b").where("track_a <> track_b")
    rows = rows.select(F.least("track_a", "track_b").alias("a"), F.greatest("track_a", "track_b").alias("b")).distinct()
    mine = library.select("track").distinct()
    return rows.join(mine, F.col("a") == F.col("track"), "left_semi").union(rows.join(mine, F.col("b") == F.col("track"), "left_semi")).distinct()


def better_files(better: DataFrame, library: DataFrame, files: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(track, file, step): library tracks with a better file; one that was dismissed for both files' contents is none, unless the linked file is gone."""
    key = files.select(F.col("file").alias("f"), "content")
    rows = better.join(library, "track").join(key.toDF("file", "other_key"), "file").join(key.toDF("linked", "linked_key"), "linked", "left")
    gone = rows.where("step = 'onDisk'")
    open_ = rows.where("step <> 'onDisk'").join(dismissed.select("linked_key", "other_key").distinct(), ["linked_key", "other_key"], "left_anti")
    return gone.unionByName(open_).select("track", "file", "step")


def quality_queue(flagged: DataFrame, library: DataFrame, better: DataFrame, answered: DataFrame) -> DataFrame:
    """(track): library tracks whose linked file is flagged, without a better copy and not answered for its content."""
    rows = library.join(flagged.withColumnRenamed("file", "linked"), "linked")
    return rows.join(better.select("track"), "track", "left_anti").join(answered.select("content"), "content", "left_anti").select("track").distinct()


def hidden_files(files: DataFrame, copies: DataFrame) -> DataFrame:
    """(file, track): files with a reason, with their tracks if any, and extra copies; each once."""
    reasoned = files.where("reason IS NOT NULL").select("file").join(copies.select("file", "track"), "file", "left")
    return reasoned.union(copies.where("role = 'extra'").select("file", "track")).distinct()


def keep_suggestion(candidates: DataFrame, group: str) -> DataFrame:
    """(group, keep, why) of ``candidates(group, track, cues, plays, rank)`` of two or more: most cues, most plays, best file, lowest id."""
    order = F.struct((-F.col("cues")).alias("cues"), (-F.col("plays")).alias("plays"), "rank", "track")
    # the least two of each group, without collecting it: the least, and the least of the rest
    first = candidates.groupBy(group).agg(F.min(order).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    rest = candidates.join(first, group).where(order != F.col("top")).groupBy(group).agg(F.min(order).alias("next"))
    differs = lambda c: F.col("top")[c] != F.col("next")[c]
    why = F.when(differs("cues"), "moreCues").when(differs("plays"), "morePlays").when(differs("rank"), "betterFile").otherwise("tied")
    return first.join(rest, group).select(group, F.col("top")["track"].alias("keep"), why.alias("why"))


def why_ahead(ranked: DataFrame, group: str, steps: list[str], order: Column) -> DataFrame:
    """Each row of a ranking but a group's first, with the first of the ordering columns ``steps`` in which the row before it differs."""
    w = W.partitionBy(group).orderBy(order)
    rows = ranked.withColumn("before", F.lag(F.struct(*steps)).over(w)).where("before IS NOT NULL")
    differs = [F.when(~F.col(s).eqNullSafe(F.col("before")[s]), s) for s in steps]
    return rows.withColumn("why", F.coalesce(*differs)).drop("before")


def rank_suggestions(candidates: DataFrame, key: list[str], strength: dict[str, int]) -> DataFrame:
    """(*key, value, sources, place): tidied values other than the current, by number of sources, strongest source, then value.

    ``candidates(*key, value, source, current)``; a smaller strength is stronger.
    """
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    power = F.try_element_at(F.create_map(*[F.lit(x) for p in strength.items() for x in p]), F.col("source"))
    rows = candidates.withColumn("value", tidy("value")).where((F.col("value") != "") & ~F.coalesce(F.col("value") == tidy("current"), F.lit(False)))
    merged = rows.groupBy(*key, "value").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min(power).alias("power"))
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.size("sources")), "power", "value"))
    return merged.withColumn("place", place).drop("power")


def touched(log: DataFrame, tables: dict[str, str]) -> DataFrame:
    """(track): the tracks that the entries of a log name, in whichever column holds them for the entry's table."""
    parts = [log.where(F.col("tbl") == t).select(F.col(c).cast("long").alias("track")) for t, c in tables.items()]
    return functools.reduce(DataFrame.union, parts).where("track IS NOT NULL").distinct()


def mark(due: DataFrame, changes: DataFrame) -> DataFrame:
    """A table of due ids with those of a change table added, each once."""
    return due.union(changes).distinct()


def expand(due: DataFrame, library: DataFrame) -> DataFrame:
    """Due ids with the mark for all library tracks replaced by these."""
    every = due.where(F.col("track") == EVERY).limit(1).select(F.lit(True).alias("every"))
    mine = library.join(F.broadcast(every)).select("track")  # one row or none
    return due.where(F.col("track") != EVERY).union(mine).distinct()


def take_batch(due: DataFrame, batch: int = 500) -> tuple[DataFrame, DataFrame]:
    """The lowest ``batch`` ids, and the rest; the batch is bounded, so it is broadcast."""
    taken = stored(due.orderBy("track").limit(batch), "batch")
    return taken, due.join(F.broadcast(taken), "track", "left_anti")


def churned(before: DataFrame, after: DataFrame, key: str, *columns: str) -> DataFrame:
    """The keys whose columns really changed between two reads, those that came and those that went included."""
    one = lambda df, name: df.select(F.col(key), F.struct(*columns).alias(name))
    both = one(before, "was").join(one(after, "now"), key, "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(key)


def due_again(decided: DataFrame, states: DataFrame, key: str, state: str) -> DataFrame:
    """The decided keys whose state is another than the one they were decided at."""
    now = states.select(F.col(key), F.col(state).alias("now__"))
    return decided.join(now, key, "left").where(~F.col(state).eqNullSafe(F.col("now__"))).select(key)


def arrivals(walk: DataFrame, baseline: DataFrame, items: DataFrame) -> DataFrame:
    """New inbox items: files of a walk that the first walk of their folder did not have and that are no items yet; a folder without a first walk has none."""
    known = baseline.select("folder").distinct()
    return walk.join(known, "folder", "left_semi").join(baseline.select("file"), "file", "left_anti").join(items.select("file"), "file", "left_anti").dropDuplicates(["file"])


def tick_off(wishes: DataFrame, new_files: DataFrame) -> DataFrame:
    """(wish, file): open wishes with an arrival of exactly their keys, the lowest file; with a stream of arrivals this is a stream-static join."""
    found = wishes.where("acquired IS NULL").join(new_files, ["artist", "title", "version"])
    return found.groupBy("wish").agg(F.min("file").alias("file"))


def batch_needed(last: int | None, featured: int, over: float = 0.05) -> bool:
    """Whether scores of all tracks are due again: there was no run, or the number of tracks moved by more than a twentieth."""
    return featured > 0 and (not last or abs(featured - last) / last > over)


def moved_files(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """(track, file): library tracks whose file is gone, and the one present file of the same content; none if there are several."""
    here = files.where("present").groupBy("content").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n = 1").drop("n")
    gone = tracks.join(files.where("not present").select(F.col("file").alias("linked"), "content"), "linked")
    return gone.join(here, "content").select("track", "file")


def regroup(now: DataFrame, plan: DataFrame) -> DataFrame:
    """(file, set): a grouping with a plan's rows put in their files' places; files that the plan does not name stay."""
    rest = now.join(plan.select("file"), "file", "left_anti")
    return rest.unionByName(plan)

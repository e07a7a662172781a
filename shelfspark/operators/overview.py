"""Dashboard numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import text
from shelfspark.operators import filters


def _count(bit: int) -> F.Column:
    return F.sum((F.col("flags").bitwiseAND(bit) != 0).cast("long"))


def totals(rows: DataFrame) -> DataFrame:
    """One row of numbers over the library, in one pass."""
    mine = rows.where(F.col("flags").bitwiseAND(filters.IN_LIBRARY) != 0)
    return mine.agg(
        F.count("*").alias("tracks"),
        F.coalesce(F.sum("time_ms"), F.lit(0)).alias("total_ms"),
        F.coalesce(_count(filters.MISSING), F.lit(0)).alias("missing"),
        F.coalesce(_count(filters.LOW_QUALITY), F.lit(0)).alias("low_quality"),
        F.coalesce(_count(filters.NO_TAGS), F.lit(0)).alias("missing_tags"),
        F.coalesce(_count(filters.NO_ART), F.lit(0)).alias("missing_art"),
        F.count(F.when(F.col("bpm").isNotNull() & F.col("key_order").isNotNull(), 1)).alias("analyzed"),
    )


def all_music(rows: DataFrame) -> DataFrame:
    outside = (F.col("flags").bitwiseAND(filters.IN_LIBRARY) == 0).cast("long")
    return rows.agg(F.count("*").alias("tracks"), F.coalesce(F.sum(outside), F.lit(0)).alias("outside"))


def flag_mix(rows: DataFrame) -> DataFrame:
    """Tracks by mix of energy and the three counted flags: a small table from which bars and counters are read."""
    mask = filters.ENERGY | filters.LOW_QUALITY | filters.NO_TAGS | filters.NO_ART
    return rows.groupBy(F.col("flags").bitwiseAND(mask).alias("mix")).agg(F.count("*").alias("n"))


def energy_bars(rows: DataFrame) -> DataFrame:
    """Library tracks of each energy 1 to 10, zeros included."""
    mine = rows.where(F.col("flags").bitwiseAND(filters.IN_LIBRARY) != 0)
    counts = mine.groupBy(F.shiftright(F.col("flags").bitwiseAND(filters.ENERGY), 8).alias("energy")).agg(F.count("*").alias("n"))
    levels = rows.sparkSession.range(1, 11).withColumnRenamed("id", "energy")
    return levels.join(F.broadcast(counts), "energy", "left").select("energy", F.coalesce("n", F.lit(0)).alias("n"))


def rank_genres(rows: DataFrame) -> DataFrame:
    """Genres by group: the most used spelling (the smallest on a tie), most tracks first."""
    spelled = rows.where("trim(genre) <> ''").select(F.trim("genre").alias("genre"), text.genre_group(F.col("genre")).alias("grp"))
    by_spelling = spelled.groupBy("grp", "genre").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("genre").alias("genre")))
    return by_spelling.groupBy("grp").agg(best["genre"].alias("genre"), F.sum("n").alias("tracks")).select("genre", "tracks").orderBy(F.desc("tracks"), "genre")


def crate_summary(entries: DataFrame, rows: DataFrame, crate: str = "crate_id") -> DataFrame:
    """Per collection: tracks, length, range of tempo and energy, number of keys and its three top genres."""
    own = entries.join(rows, "recording_id")
    base = own.groupBy(crate).agg(
        F.count("*").alias("tracks"),
        F.coalesce(F.sum("time_ms"), F.lit(0)).alias("total_ms"),
        F.min("bpm").alias("bpm_min"),
        F.max("bpm").alias("bpm_max"),
        F.min("energy").alias("energy_min"),
        F.max("energy").alias("energy_max"),
        F.countDistinct("key_order").alias("keys"),
    )
    genres = own.where("genre_group is not null").groupBy(crate, "genre_group").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(crate).orderBy(F.desc("n"), "genre_group"))
    top = genres.withColumn("place", place).where("place <= 3").groupBy(crate).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "genre_group"))), lambda g: g["genre_group"]), ", ").alias("top_genres"))
    return base.join(top, crate, "left")


def key_agreement(pairs: DataFrame) -> DataFrame:
    """Counts of how estimated keys relate to known ones (``known``, ``estimated`` places on the wheel), per genre and over all."""
    steps = F.abs(F.floor(F.col("known") / 2) - F.floor(F.col("estimated") / 2))
    steps, same = F.least(steps, 12 - steps), F.col("known") % 2 == F.col("estimated") % 2
    kinds = {
        "exact": (steps == 0) & same,
        "relative": (steps == 0) & ~same,
        "one_step": (steps == 1) & same,
        "parallel": (steps == 3) & ~same,
    }
    other = ~(kinds["exact"] | kinds["relative"] | kinds["one_step"] | kinds["parallel"])
    counts = [F.count(F.when(c, 1)).alias(k) for k, c in {**kinds, "other": other}.items()]
    rows = pairs.where("known is not null and estimated is not null and genre is not null")
    return rows.rollup("genre").agg(F.count("*").alias("tracks"), *counts)

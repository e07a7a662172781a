"""Ordered lists and histories: timelines, transitions, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import music


def target_at(points: list[tuple[float, float]], at: Column) -> Column:
    """Piecewise linear value of a target curve, flat beyond its ends; null without points."""
    if not points:
        return F.lit(None).cast("double")
    points = sorted(points)
    out = F.when(at <= points[0][0], float(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x1 > x0:
            out = out.when(at <= x1, y0 + (y1 - y0) * (at - x0) / (x1 - x0))
    return out.otherwise(float(points[-1][1]))


def timeline(entries: DataFrame, target: list[tuple[float, float]], by: str = "playlist_id") -> DataFrame:
    """Start of each entry, the target there, and how it flows into the next: fine, clash or unknown per signal.

    ``entries`` has the list's id, position, recording_id, time_ms, bpm, key_order and energy.
    """
    order = Window.partitionBy(by).orderBy("position", "recording_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum("time_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = {f"next_{c}": F.lead(c).over(order) for c in ("bpm", "key_order", "energy")}
    rows = entries.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(whole), "start_ms": F.coalesce(before, F.lit(0)), **after})
    # what is used several times is a column of its own, so that it is worked out once
    at = F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(0.0)
    a, b = F.col("key_order"), F.col("next_key_order")
    rows = rows.withColumns({"at": at, "steps": music.steps_apart(a, b), "same": (a % 2) == (b % 2), "gap": music.tempo_gap(F.col("bpm"), F.col("next_bpm")), "step": F.col("next_energy") - F.col("energy")})
    any_way = F.greatest(*(music.energy_fitness(F.col("step"), k) for k in (-1, 0, 1)))
    rows = rows.withColumns({"relation": music.relation_of(F.col("steps"), F.col("same")), "bpm_fits": music.tempo_fitness(F.col("gap")), "energy_fits": F.when(F.col("step").isNotNull(), any_way)})
    rows = rows.withColumn("key_fits", music.relation_fitness(F.col("relation")))

    def flow(fitness: Column) -> Column:
        return F.when(F.col("i") + 1 == F.col("n"), F.lit(None).cast("string")).when(fitness.isNull(), "unknown").when(fitness > 0, "fine").otherwise("clash")

    return rows.select(
        by,
        "position",
        "recording_id",
        "start_ms",
        F.round(target_at(target, F.col("at")), 6).alias("target"),
        flow(F.col("key_fits")).alias("key_flow"),
        flow(F.col("bpm_fits")).alias("bpm_flow"),
        flow(F.col("energy_fits")).alias("energy_flow"),
    )


def transitions(plays: DataFrame, session: str, order: list[str], track: str) -> DataFrame:
    """(src, dst, n): how often one track was played right after another, both known and different."""
    after = F.lead(track).over(Window.partitionBy(session).orderBy(*order))
    pairs = plays.select(F.col(track).alias("src"), after.alias("dst")).where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def sessions(plays: DataFrame, who: str, ts: str, gap_seconds: int, most_seconds: int | None = None) -> DataFrame:
    """Sessions of a batch: a new one after a gap; with ``most_seconds`` also when a fixed slot of its length is over.

    A timestamp without a zone is read in the session's.
    """
    order = Window.partitionBy(who).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce(at - F.lag(at).over(order) > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    rows = plays.withColumn("at__", at).withColumn("s__", F.sum(new).over(order))
    by = [who, "s__"]
    if most_seconds:
        first = F.min("at__").over(Window.partitionBy(who, "s__"))
        rows = rows.withColumn("slot__", F.floor((F.col("at__") - first) / (most_seconds * 1_000_000)))
        by.append("slot__")
    return rows.groupBy(*by).agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count("*").alias("plays")).drop("s__", "slot__")

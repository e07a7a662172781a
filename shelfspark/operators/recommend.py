"""Ranking by fit: sort by fit, what comes next, and what bridges two tracks. One pass over the candidates, then a top-k."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import music

# How much each signal counts unless the user says otherwise.
WEIGHTS = {"key": 4, "bpm": 4, "energy": 2, "played": 2, "genre": 0, "tags": 1, "similar": 1}
FACTS = ("key", "bpm", "energy", "played", "genre", "tags")
SHOWN = 10


@dataclass(frozen=True)
class Settings:
    weights: Mapping[str, int] = field(default_factory=lambda: dict(WEIGHTS))
    wide: bool = False
    #: Ideal energy step: 1 up, 0 the same, -1 down.
    direction: int = 0


def fit_order(rows: DataFrame, target: Mapping[str, Any]) -> DataFrame:
    """recording_id, points, dots and spread of every row; the target first, then points, spread (missing last) and id."""
    key, bpm = F.lit(target["key_order"]).cast("int"), F.lit(target["bpm"]).cast("double")
    same = F.col("key_order") == key
    near = music.key_relation(key, F.col("key_order")).isin("adjacent", "relative")
    gap = music.tempo_gap(bpm, F.col("bpm"))
    points = F.coalesce(F.when(same, 3).when(near, 2), F.lit(0)) + music.tempo_points(gap)
    out = rows.select("recording_id", points.alias("points"), F.abs(gap).alias("spread"))
    dots = F.when(F.col("points") >= 5, 3).when(F.col("points") == 4, 2).when(F.col("points") >= 2, 1).otherwise(0)
    chosen = F.col("recording_id") == target["recording_id"]
    return out.select("recording_id", "points", dots.alias("dots"), "spread").orderBy(chosen.desc(), F.desc("points"), F.col("spread").asc_nulls_last(), "recording_id")


def _parts(target: Mapping[str, Any], settings: Settings) -> dict[str, Column]:
    """Fitness of a candidate by signal; null where the target has nothing to compare."""
    has = lambda k: target.get(k) is not None
    out: dict[str, Column] = {}
    if has("key_order"):
        out["key"] = F.coalesce(music.key_fitness(F.lit(target["key_order"]), F.col("key_order"), settings.wide), F.lit(0.0))
    if has("bpm"):
        out["bpm"] = F.coalesce(music.tempo_fitness(music.tempo_gap(F.lit(float(target["bpm"])), F.col("bpm")), settings.wide), F.lit(0.0))
    if has("energy"):
        out["energy"] = music.energy_fitness(F.col("energy") - target["energy"], settings.direction, settings.wide)
    if target.get("played"):
        out["played"] = 1 - F.pow(F.lit(0.5), F.least(F.coalesce("played", F.lit(0)), F.lit(30)))
    if has("genre"):
        node, parent = (F.lit(x).cast("long") for x in target["genre"])
        beside = (F.col("genre_parent") == parent) | (F.col("genre_parent") == node) | (F.col("genre_node") == parent)
        out["genre"] = F.when(F.col("genre_node") == node, 1.0).when(beside, 0.5).otherwise(0.0)
    if target.get("tags"):
        n = min(max(len(target["tags"]), 1), 3)
        shared = F.size(F.array_intersect("tags", F.array(*map(F.lit, target["tags"]))))
        out["tags"] = F.coalesce(F.least(F.greatest(shared, F.lit(0)) / n, F.lit(1.0)), F.lit(0.0))
    if target.get("similar"):
        out["similar"] = F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0))
    return {k: v for k, v in out.items() if settings.weights.get(k, 0) > 0}


def score(rows: DataFrame, target: Mapping[str, Any], settings: Settings) -> DataFrame:
    """Each candidate's parts ``f_*``, the weighted mean ``raw`` and ``lacks_energy``.

    A missing energy leaves the mean; similarity counts only beside a fact that is above zero.
    """
    parts = _parts(target, settings)
    rows = rows.where(F.col("recording_id") != target["recording_id"]).withColumns({f"f_{k}": v for k, v in parts.items()})
    fact = F.lit(False)
    for k in FACTS:
        if k in parts:
            fact |= F.coalesce(F.col(f"f_{k}") > 0, F.lit(False))
    total, weight = F.lit(0.0), F.lit(0)
    for k in parts:
        w = settings.weights[k]
        counts = F.col(f"f_{k}").isNotNull() & (fact if k == "similar" else F.lit(True))
        total += F.when(counts, F.col(f"f_{k}") * w).otherwise(0.0)
        weight += F.when(counts, w).otherwise(0)
    lacks = F.col("f_energy").isNull() if "energy" in parts else F.lit(False)
    return rows.withColumns({"raw": F.when(weight > 0, total / weight).otherwise(0.0), "lacks_energy": lacks})


def reasons(parts: list[str], weights: Mapping[str, int], most: int = 3) -> Column:
    """The signals that contributed most, as names; those of no fitness are no reason."""
    all_ = [F.struct((-F.coalesce(F.col(f"f_{k}"), F.lit(0.0)) * weights[k]).alias("w"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(parts)]
    if not all_:
        return F.lit("")
    kept = F.filter(F.array_sort(F.array(*all_)), lambda r: r["w"] < 0)
    return F.array_join(F.transform(F.slice(kept, 1, most), lambda r: r["k"]), ",")


def next_for(rows: DataFrame, target: Mapping[str, Any], settings: Settings = Settings(), most: int = SHOWN) -> DataFrame:
    """The best candidates after a track: recording_id, score (0 to 100) and reasons."""
    found = score(rows, target, settings)
    parts = [k for k in settings.weights if f"f_{k}" in found.columns]
    top = found.orderBy("lacks_energy", F.desc("raw"), "recording_id").limit(most)
    return top.select("recording_id", F.round(F.col("raw") * 100).cast("int").alias("score"), reasons(parts, settings.weights).alias("reasons"), "lacks_energy")


def bridge(rows: DataFrame, before: Mapping[str, Any] | None, after: Mapping[str, Any] | None, settings: Settings = Settings(), want_energy: float | None = None, most: int = 50) -> DataFrame:
    """Tracks to put between two: per signal the worse of the two legs; results without a score are left out."""
    ends = [e for e in (before, after) if e]
    energies = [e["energy"] for e in ends if e.get("energy") is not None]
    want = want_energy if want_energy is not None else sum(energies) / len(energies) if energies else None
    legs = [_parts({k: v for k, v in e.items() if k != "energy"}, settings) for e in ends]
    parts = {k: [leg[k] for leg in legs if k in leg] for k in settings.weights}
    worst = {k: (F.least(*v) if len(v) > 1 else v[0]) for k, v in parts.items() if v}
    if want is not None and settings.weights.get("energy", 0) > 0:
        worst["energy"] = music.energy_fitness(F.round(F.col("energy") - want), 0, settings.wide)
    used = rows.where(~F.col("recording_id").isin([e["recording_id"] for e in ends])).withColumns({f"f_{k}": v for k, v in worst.items()})
    total = sum((F.coalesce(F.col(f"f_{k}"), F.lit(0.0)) * settings.weights[k] for k in worst), F.lit(0.0))
    weight = sum((F.when(F.col(f"f_{k}").isNotNull(), settings.weights[k]).otherwise(0) for k in worst), F.lit(0))
    lacks = F.col("f_energy").isNull() if "energy" in worst else F.lit(False)
    used = used.withColumns({"raw": F.when(weight > 0, total / weight).otherwise(0.0), "lacks_energy": lacks})
    out = used.withColumns({"score": F.round(F.col("raw") * 100).cast("int"), "reasons": reasons([k for k in settings.weights if k in worst], settings.weights)})
    return out.where("score > 0 and reasons <> ''").orderBy("lacks_energy", F.desc("raw"), "recording_id").limit(most).select("recording_id", "score", "reasons", "lacks_energy")

"""Set operations of collections."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators import filters
from shelfspark.storage import stored


def smart_members(rows: DataFrame, rule: dict[str, Any], always: DataFrame, never: DataFrame) -> DataFrame:
    """recording_id of the members: library tracks by the rule, without ``never``, and ``always``."""
    found = rows.where((F.col("flags").bitwiseAND(filters.IN_LIBRARY) != 0) & filters.rule(rule)).select("recording_id")
    found = found.join(never.select("recording_id"), "recording_id", "left_anti")
    return found.unionByName(always.select("recording_id").join(rows.select("recording_id"), "recording_id", "left_semi")).distinct()


def tracks_to_playlist(entries: DataFrame, by: str = "playlist_id") -> DataFrame:
    """Playlists as ordered bags: one row each, its tracks in order, repeats kept."""
    return entries.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "recording_id"))), lambda e: e["recording_id"]).alias("tracks"))


def descendants(nodes: DataFrame, most: int = 64) -> DataFrame:
    """(node, ancestor, depth) of a forest ``nodes(node, parent)``: each pass joins what the last one found with the parents."""
    up = nodes.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    found = up
    step = nodes.where("parent is not null").select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    for depth in range(2, most + 1):
        up = stored(up.join(step, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(depth).alias("depth")), "tree-level")
        if up.isEmpty():
            return found
        found = found.unionByName(up)
    raise ValueError("the tree is too deep or has a cycle")


def folder_contents(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Per node with descendants: nodes below it, levels, entries and different tracks in and below it."""
    below = descendants(nodes)
    tree = below.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("nodes"), F.max("depth").alias("levels"))
    own = below.select("node", "ancestor").unionByName(nodes.select("node", F.col("node").alias("ancestor")))
    filled = entries.join(own, "node").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("entries"), F.countDistinct("recording_id").alias("tracks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return tree.join(filled, "node", "left").select("node", "nodes", "levels", zero("entries"), zero("tracks"))

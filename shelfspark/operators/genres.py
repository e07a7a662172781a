"""A genre tree: resolving spellings and counting per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(c: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def resolve(spellings: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(spelling, node, how): exact name, folded name, ``Parent (Sub)``, then alias; null if none is the only one.

    ``nodes(node, name, parent)``, ``aliases(alias, node)``. A folded name that several nodes have resolves nothing.
    """
    names = nodes.groupBy(F.col("name").alias("k")).agg(F.min("node").alias("exact"))
    folded = nodes.groupBy(_fold(F.col("name")).alias("k")).agg(F.min("node").alias("folded"), F.count("*").alias("n")).where("n = 1").drop("n")
    parent = nodes.select(F.col("node").alias("parent"), F.col("name").alias("up"))
    subs = nodes.join(parent, "parent").groupBy(F.concat_ws("/", _fold(F.col("up")), _fold(F.col("name"))).alias("k")).agg(F.min("node").alias("sub"))
    other = aliases.groupBy(_fold(F.col("alias")).alias("k")).agg(F.min("node").alias("aliased"), F.count("*").alias("n")).where("n = 1").drop("n")
    own = spellings.select("spelling").distinct().withColumns(
        {
            "f": _fold(F.col("spelling")),
            "s": F.concat_ws("/", _fold(F.regexp_extract("spelling", r"^(.*?)\s*\((.*)\)\s*$", 1)), _fold(F.regexp_extract("spelling", r"^(.*?)\s*\((.*)\)\s*$", 2))),
        }
    )
    for table, key in ((names, "spelling"), (folded, "f"), (subs, "s"), (other, "f")):
        own = own.join(table.withColumnRenamed("k", "k__"), F.col(key) == F.col("k__"), "left").drop("k__")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("folded").isNotNull(), "folded").when(F.col("sub").isNotNull(), "sub").when(F.col("aliased").isNotNull(), "alias")
    return own.select("spelling", F.coalesce("exact", "folded", "sub", "aliased").alias("node"), how.alias("how"))


def spellings(rows: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(spelling, tracks, node, how): each spelling of ``rows(genre)``, how many tracks use it, and what it resolves to."""
    counted = rows.where("genre IS NOT NULL").groupBy(F.col("genre").alias("spelling")).agg(F.count("*").alias("tracks"))
    return counted.join(resolve(counted.select("spelling"), nodes, aliases), "spelling")


def unmapped(rows: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(spelling, tracks) of the spellings that resolve to nothing; a null one stands for the tracks without a genre."""
    none = rows.where("genre IS NULL").agg(F.count("*").alias("tracks")).select(F.lit(None).cast("string").alias("spelling"), "tracks")
    return spellings(rows, nodes, aliases).where("node IS NULL").select("spelling", "tracks").unionByName(none)


def tree_counts(rows: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Rows of each node, zeros included."""
    counts = rows.groupBy(node).agg(F.count("*").alias("n"))
    return nodes.join(counts, nodes["node"] == counts[node], "left").select(nodes["node"], "name", F.coalesce("n", F.lit(0)).alias("n"))

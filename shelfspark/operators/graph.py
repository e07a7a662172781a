"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.storage import stored


def _toward_least(edges: DataFrame, own: bool) -> DataFrame:
    """Point each neighbour in ``edges(u, v)`` of u at the least one; with ``own`` u itself too."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u")
    near = F.least("u", "least")
    if own:  # every v is below u here, so u moves to the least of them as well
        ends = F.array(F.col("v"), F.col("u"))
        moved = moved.select(F.explode(ends).alias("u"), F.col("least").alias("v"))
    else:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), near.alias("v"))
    return moved.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """Return (node, component): the least node that each node of ``edges`` reaches.

    Alternating large-star and small-star rounds: every round is one grouping and
    one equi-join on the node, whose hot keys adaptive execution can split, so no
    neighbourhood is ever collected. Each round is written to the shared folder.
    Null ends and self-loops link nothing and are left out; nodes without a link
    are not in the result. An empty table gives an empty one.
    """
    now = edges.where(F.col(src) != F.col(dst)).select(
        F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    )
    now = stored(now.distinct(), "components")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = stored(_toward_least(_toward_least(both, own=False), own=True), "components")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return leaves.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))

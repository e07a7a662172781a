"""Consecutive numbers for the rows of a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.storage import stored


def numbered(rows: DataFrame, order: list[str], name: str, start: int | Column = 0) -> DataFrame:
    """``rows`` with ``name``: start, start + 1, ... in the order of ``order``, which should tell rows apart.

    Rows are dealt into ranges and numbered within each; only the ranges' sizes, a row for
    each, are put in order in one task.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("part__", F.spark_partition_id()), "numbering")
    within = F.row_number().over(Window.partitionBy("part__").orderBy(*order)) - 1
    up_to = F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n__")
    sizes = dealt.groupBy("part__").agg(F.count("*").alias("n__")).select("part__", up_to.alias("base__"))
    start = start if isinstance(start, Column) else F.lit(start).cast("long")
    return dealt.withColumn("within__", within).join(F.broadcast(sizes), "part__").withColumn(name, start + F.col("base__") + F.col("within__")).drop("part__", "within__", "base__")

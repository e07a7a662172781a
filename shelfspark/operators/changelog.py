"""An append-only log of changes: the state at a time, and what undoing an operation would do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.numbering import numbered
from shelfspark.sources.keyed_table import KeyedTable
from shelfspark.storage import stored

KEY = ["entity", "id", "field"]


def as_of(changes: DataFrame, seq: int) -> DataFrame:
    """(entity, id, field, value): the last value of every field at or before a change number, undone ones left out.

    ``changes(seq, operation, entity, id, field, before, after, undone)``.
    """
    kept = changes.where((F.col("seq") <= seq) & ~F.col("undone"))
    last = kept.groupBy(*KEY).agg(F.max_by("after", "seq").alias("value"))
    return last.where("value is not null")


def undo(changes: DataFrame, operation: int) -> DataFrame:
    """(entity, id, field, value, clash, allowed): the fields an operation changed and what they would get back.

    A field that a later operation changed clashes, and one that clashes stops the whole undo.
    """
    own = changes.where((F.col("operation") == operation) & ~F.col("undone"))
    mine = own.groupBy(*KEY).agg(F.min_by("before", "seq").alias("value"), F.max("seq").alias("last"))
    others = changes.where("undoes IS NULL") if "undoes" in changes.columns else changes  # an undo only puts back what stood
    later = others.where((F.col("operation") != operation) & ~F.col("undone")).select(*KEY, F.col("seq").alias("other"))
    clash = mine.join(later, KEY).where("other > last").select(*KEY).distinct().withColumn("clash", F.lit(True))
    stopped = F.broadcast(clash.select(F.lit(False).alias("allowed")).limit(1))  # one row or none
    out = mine.join(clash, KEY, "left").join(stopped, F.lit(True), "left")
    return out.select(*KEY, "value", F.col("clash").isNotNull().alias("clash"), F.coalesce("allowed", F.lit(True)).alias("allowed"))


def append(changes: DataFrame, operation: int, new: DataFrame) -> DataFrame:
    """``changes`` with an operation's values ``new(entity, id, field, after)`` that differ from what stands now.

    Numbers go on from the last one, by entity, id and field; an operation of any size is
    numbered by ranges. A log with a column ``undoes`` gets null there.
    """
    now = as_of(changes, 1 << 62).withColumnRenamed("value", "before")
    moved = new.join(now, KEY, "left").where(~F.col("after").eqNullSafe(F.col("before")))
    rows = moved.select(F.lit(operation).alias("operation"), *KEY, "before", "after", F.lit(False).alias("undone"), F.lit(None).cast("long").alias("undoes"))
    return _joined(changes, rows)


def _joined(changes: DataFrame, rows: DataFrame) -> DataFrame:
    """``changes`` and, numbered from the last one on, ``rows``."""
    last = changes.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last")).first().last
    placed = numbered(rows, KEY, "seq", last + 1)
    return changes.unionByName(placed.select(*(F.col(c).cast(changes.schema[c].dataType).alias(c) for c in changes.columns)))


def next_undo(changes: DataFrame) -> int | None:
    """The latest operation that is not undone and does not itself undo one; None if there is none."""
    return changes.where(~F.col("undone") & F.col("undoes").isNull()).agg(F.max("operation").alias("operation")).first().operation


def undo_next(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take back the latest operation: the log that follows, and what to write (entity, id, field, value; null: delete).

    The operation is marked undone and its inverse appended as an operation of its own, which
    names in ``undoes`` what it takes back, so the state after is the state before, by either
    reading of the log. Refused as a whole, with the log as it was and nothing to write, if a
    later operation changed one of its fields.
    """
    operation = next_undo(changes)
    found = stored(undo(changes, operation), "undo") if operation is not None else None
    if found is None or not found.where("allowed").limit(1).count():
        return changes, changes.select(*KEY, F.col("after").alias("value")).limit(0)
    number = changes.agg(F.max("operation").alias("n")).first().n + 1
    now = as_of(changes, 1 << 62).withColumnRenamed("value", "before")
    inverse = found.join(now, KEY, "left").select(F.lit(number).alias("operation"), *KEY, "before", F.col("value").alias("after"), F.lit(False).alias("undone"), F.lit(operation).alias("undoes"))
    marked = changes.withColumn("undone", F.col("undone") | (F.col("operation") == operation))
    return _joined(marked, inverse), found.select(*KEY, "value")


def write_back(table: KeyedTable, values: DataFrame, source: str | None = None, batch: int | None = None) -> int:
    """Write values (entity, id, field, value) to a table of what stands, null ones as deletions; its version after."""
    return table.upsert(values, gone=F.col("value").isNull(), source=source, batch=batch)

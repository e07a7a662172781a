"""A feed of captured changes, drained page by page into a keyed table, and arrivals met with open wishes.

Changes of base rows are appended as marks (key, at). A stateful operator holds the marks of
each key until the key has been quiet, so a burst of changes settles once; due keys are
settled in pages of a bounded size, and every batch of pages is applied exactly once: the
keyed table remembers the last batch of each source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfspark.sources.keyed_table import KeyedTable

#: A key is due when it has been quiet for so many seconds, or has waited for so many.
QUIET_S, LONGEST_S = 3, 60
PAGE = 500


def captured(before: DataFrame, after: DataFrame, key: str, columns: list[str], at: Column) -> DataFrame:
    """(key, at): a mark for each row that is new, gone or differs in one of ``columns``; what a trigger would have written."""
    rows = lambda t, side: t.select(F.col(key).alias("key"), F.struct(*columns).alias("row"), F.lit(side).alias("side"))
    both = rows(before, 0).unionByName(rows(after, 1)).groupBy("key")
    moved = both.agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n")).where("n <> 2 OR NOT (low <=> high)")
    return moved.select(F.col("key"), at.alias("at"))


def due(marks: DataFrame, quiet: float = QUIET_S, longest: float = LONGEST_S, late: str = "10 seconds") -> DataFrame:
    """(key, marks, first, last) of a stream of marks (key long, at timestamp): each key once when its burst is over.

    A burst is over after ``quiet`` seconds without a mark, or ``longest`` after its first.
    State is three numbers a key; a timer lets go of keys that no mark follows.
    """
    rows = marks.select(F.col("key").cast("long").alias("key"), "at").withWatermark("at", late)
    out_schema = "key long, marks long, first timestamp, last timestamp"

    def out(key: int, bursts: list[tuple[float, float, int]]) -> pd.DataFrame:
        time = lambda k: pd.to_datetime(pd.Series([b[k] for b in bursts], dtype="float64"), unit="s")
        return pd.DataFrame({"key": pd.Series([key] * len(bursts), dtype="int64"), "marks": pd.Series([b[2] for b in bursts], dtype="int64"), "first": time(0), "last": time(1)})

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield out(key[0], [held])
            return
        done, now = [], held
        for t in sorted(t for p in parts for t in p["at"].astype("datetime64[us]").astype("int64") / 1e6):
            if now and (t >= now[1] + quiet or t >= now[0] + longest):
                done.append(now)
                now = None
            now = (now[0], t, now[2] + 1) if now else (t, t, 1)
        state.update((float(now[0]), float(now[1]), int(now[2])))
        ends = min(now[1] + quiet, now[0] + longest)
        state.setTimeoutTimestamp(max(int(ends * 1000), state.getCurrentWatermarkMs() + 1))
        yield out(key[0], done)

    return rows.groupBy("key").applyInPandasWithState(step, out_schema, "first double, last double, marks long", "append", GroupStateTimeout.EventTimeTimeout)


def paged(keys: DataFrame, size: int = PAGE) -> DataFrame:
    """``keys(key)`` dealt by hash, so that a task holds a page of about ``size`` keys; one key stays in one page."""
    return keys.repartition(max(1, -(-keys.count() // size)), "key")


def settle(stream: DataFrame, derive: Callable[[DataFrame], DataFrame], table: KeyedTable, checkpoint: str, source: str, size: int = PAGE) -> StreamingQuery:
    """Bring the keyed table up to date with the keys of a stream, a micro-batch at a time.

    ``derive(keys)`` works out the rows of ``keys(key)`` from the base tables as they are now;
    keys it gives no row for are gone. It is called once for all keys of a batch, which lie in
    pages of ``size`` keys, a task each: the base tables are read once however many keys are
    due. They are one write, kept with the batch's number, so a batch that is sent again
    after a failure changes nothing.
    """
    key = table.key[0]

    def write(batch: DataFrame, number: int) -> None:
        keys = batch.select(F.col("key")).distinct().persist()
        try:
            if keys.isEmpty():
                return
            page = paged(keys, size)
            rows = derive(page).withColumn("gone__", F.lit(False))
            made = page.select(F.col("key").alias(key)).join(rows, key, "left").withColumn("gone__", F.col("gone__").isNull())
            table.upsert(made, gone=F.col("gone__"), source=source, batch=number)
        finally:
            keys.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tick_off(arrivals: DataFrame, wishes: KeyedTable, on: list[str], checkpoint: str, source: str, compact_after: int = 20) -> StreamingQuery:
    """Tick wishes off as files arrive: each open wish gets the lowest file that matches it in the batch that first brings one.

    ``arrivals(file, ...)`` is a stream, ``wishes`` a keyed table with the columns ``on`` and
    ``acquired`` (null while open). A wish that is ticked off keeps its file; a batch sent again
    changes nothing. The table is compacted after so many batches, so that reads stay cheap.
    """

    def write(batch: DataFrame, number: int) -> None:
        still = wishes.read().where("acquired IS NULL")
        lowest = batch.groupBy(*on).agg(F.min("file").alias("acquired"))  # so a wish meets one row however many files match it
        found = still.drop("acquired").join(lowest, on)
        wishes.upsert(found.select(*wishes.names), source=source, batch=number)
        if sum(p["kind"] == "delta" for p in wishes.manifest()[1]) >= compact_after:
            wishes.compact()

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

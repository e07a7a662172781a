"""Streams: bursts of changes, and derived rows kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET_S, FIRST_CAP_S, LAST_CAP_S = 3, 60, 600
BURST = "root string, began timestamp, ended timestamp, events long, quiet boolean"
STATE = "began double, last double, events long, cap double"


def split_bursts(times: list[float], state: tuple[float, float, int, float] | None, quiet: float = QUIET_S) -> tuple[list[tuple], tuple[float, float, int, float]]:
    """Bursts that sorted event times close, and the open one: (began, last, events, cap).

    A burst ends after ``quiet`` seconds without an event, or when its cap is
    reached; the cap doubles up to ten minutes after a burst that never went
    quiet, and is a minute again otherwise.
    """
    closed = []
    began, last, n, cap = state or (0.0, 0.0, 0, float(FIRST_CAP_S))
    for t in times:
        if n and t >= (due := min(last + quiet, began + cap)):
            calm = due == last + quiet
            closed.append((began, last, n, calm))
            cap = float(FIRST_CAP_S) if calm else min(cap * 2, float(LAST_CAP_S))
            n = 0
        began = began if n else t
        last, n = t, n + 1
    return closed, (began, last, n, cap)


def bursts(events: DataFrame, root: str = "root", ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Bursts of each root of a stream, as they close; late events beyond the watermark are dropped by Spark."""
    rows = events.select(F.col(root).cast("string").alias("root"), F.col(ts).alias("ts")).withWatermark("ts", late)

    def out(key: str, closed: list[tuple]) -> pd.DataFrame:
        cols = list(zip(*closed)) if closed else [()] * 4
        time = lambda c: pd.to_datetime(pd.Series(c, dtype="float64"), unit="s")
        return pd.DataFrame({"root": [key] * len(closed), "began": time(cols[0]), "ended": time(cols[1]), "events": pd.Series(cols[2], dtype="int64"), "quiet": pd.Series(cols[3], dtype="bool")})

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            began, last, n, _ = now
            state.remove()
            yield out(key[0], [(began, last, int(n), True)])
            return
        times = sorted(t for p in parts for t in (p["ts"].astype("int64") / (1e9 if str(p["ts"].dtype).startswith("datetime64[ns") else 1e6)))
        closed, now = split_bursts(times, now)
        state.update(now)
        state.setTimeoutTimestamp(max(int((now[1] + QUIET_S) * 1000), state.getCurrentWatermarkMs() + 1))
        yield out(key[0], closed)

    return rows.groupBy("root").applyInPandasWithState(step, BURST, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, who: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Gap sessions of a stream or a batch."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    found = rows.groupBy(who, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("plays"), F.max(ts).alias("ended"))
    return found.select(who, F.col("w.start").alias("began"), "ended", "plays")


def keep_current(changes: DataFrame, derive: Callable[[DataFrame], DataFrame], key: str, path: str, checkpoint: str):
    """Keep derived rows of changed keys: each batch derives its keys anew and appends them with the batch's number.

    Read the table with ``current``. A batch that is repeated after a failure writes the same rows again.
    """

    def settle(batch: DataFrame, number: int) -> None:
        due = batch.select(key).distinct()
        derive(due).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return changes.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(rows: DataFrame, key: str) -> DataFrame:
    """The newest row of each key."""
    names = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return last.select(key, "r.*")

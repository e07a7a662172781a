"""The list query: source, search, filters, blank-last sort, window and total."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators import filters
from shelfspark.operators.search import matches

MOST_ROWS = 500
#: Sort column -> (column, whether blanks can occur, tie-breaks before the id).
SORTS: dict[str, tuple[str, bool, tuple[str, ...]]] = {
    "title": ("title_key", False, ("artist_key",)),
    "artist": ("artist_key", True, ("title_key",)),
    "genre": ("genre_group", True, ("title_key",)),
    **{c: (c, True, ()) for c in ("bpm", "key_order", "time_ms", "rating", "energy", "added_at", "file_key", "folder_key")},
}


def order_by(sort: dict[str, Any] | None, extra: tuple[str, ...] = ()) -> list[Column]:
    """Sort columns: blanks last both ways; descending turns the tie-breaks round too; ends with the id."""
    down = bool(sort and sort.get("descending"))
    column, blanks, ties = SORTS[sort["column"]] if sort else ("title_key", False, ("artist_key",))
    way = (lambda c: F.col(c).desc_nulls_last()) if down else (lambda c: F.col(c).asc_nulls_last())
    names = (column, *ties, "recording_id", *extra)
    return [*([F.col(column).isNull().asc()] if blanks else []), *map(way, names)]


def source(rows: DataFrame, kind: str, entries: DataFrame | None = None) -> DataFrame:
    """Rows of the library, of all music, or of a collection's ``entries(recording_id, position)``, whose repeats stay."""
    if kind == "library":
        return rows.where(F.col("flags").bitwiseAND(filters.IN_LIBRARY) != 0)
    if kind == "all":
        return rows.where(F.col("flags").bitwiseAND(filters.HAS_FILE) != 0)
    return entries.join(rows, "recording_id")


def matching(rows: DataFrame, query: dict[str, Any], entries: DataFrame | None = None) -> DataFrame:
    out = source(rows, query["source"], entries).where(filters.condition(query.get("filters", [])))
    search = query.get("search")
    return out.where(matches(search, ["title", "artist", "genre"])) if search else out


def page(rows: DataFrame, query: dict[str, Any], entries: DataFrame | None = None) -> DataFrame:
    """A window of at most 500 rows. Whole rows go through the top-k, offset and limit together for each partition: one scan, and no second one for the rows shown."""
    found = matching(rows, query, entries)
    extra = ("position",) if entries is not None and query["source"] == "playlist" else ()
    if extra and not query.get("sort"):
        order = [F.col("position").asc(), F.col("recording_id").asc()]
    else:
        order = order_by(query.get("sort"), extra)
    return found.orderBy(*order).offset(query.get("offset", 0)).limit(min(query.get("limit", MOST_ROWS), MOST_ROWS))


def total(rows: DataFrame, query: dict[str, Any], entries: DataFrame | None = None) -> DataFrame:
    return matching(rows, query, entries).agg(F.count("*").alias("total"))


def position(rows: DataFrame, query: dict[str, Any], recording_id: int) -> DataFrame:
    """Index of a track in the sorted list: the rows that sort before it, counted without sorting the rest."""
    found = matching(rows, query)
    first = found.where(F.col("recording_id") == recording_id).limit(1)
    names = ["recording_id", *dict.fromkeys(c for s in SORTS.values() for c in (s[0], *s[2]))]
    both = found.select(*names).join(F.broadcast(first.select(*(F.col(c).alias(f"t_{c}") for c in names))))
    down = bool(query.get("sort") and query["sort"].get("descending"))
    column, _, ties = SORTS[query["sort"]["column"]] if query.get("sort") else ("title_key", False, ("artist_key",))
    before, same = F.lit(False), F.lit(True)
    for c in (column, *ties, "recording_id"):
        a, t = F.col(c), F.col(f"t_{c}")
        ahead = F.when(a.isNull(), False).when(t.isNull(), True).otherwise(a > t if down else a < t)
        before |= same & ahead
        same &= a.eqNullSafe(t)
    return both.agg(F.count(F.when(before, 1)).alias("position"))


def formats(rows: DataFrame, kind: str) -> DataFrame:
    return source(rows, kind).where("format is not null").select("format").distinct()

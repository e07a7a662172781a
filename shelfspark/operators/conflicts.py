"""Fields kept in two places: comparison, detection, resolution, and what to take away by hand."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import names, text
from shelfspark.operators import decisions

# Kinds of fields, and what is done about each decision.
NUMBERS = ("Size", "TotalTime", "DiscNumber", "TrackNumber", "Year", "BitRate", "SampleRate", "PlayCount")
DATES = ("DateAdded", "DateModified", "LastPlayed")
ANALYSIS = ("AverageBpm", "Tonality", "TEMPO", "POSITION_MARK")
HANDLING = {"never": "nothing", "same": "nothing", "wait": "wait", "send": "sendApp", "take": "takeExternal", "notTakenUp": "sendApp", "conflict": "review", "review": "review"}


def field_kind(field: Column) -> Column:
    """analysis, id or value: analysis fields and the track's id are never compared."""
    return F.when(field.isin(*ANALYSIS), "analysis").when(field == "TrackID", "id").otherwise("value")


def comparison_key(field: Column, value: Column) -> Column:
    """What a value is compared by, by its field's kind: number, date, stars, colour, address or text; null is no value.

    A rating that stands for no stars is compared as a number, text by its composed form, an
    address by its decoded path without letter case; what cannot be read as its kind as it stands.
    """
    v = F.coalesce(value, F.lit(""))
    unread = F.when(v != "", F.concat(F.lit("?"), v))
    number = F.when(v.rlike("^[0-9]+$"), F.concat(F.lit("n"), F.regexp_replace(v, "^0+(?=.)", "")))
    stars = F.coalesce(F.concat(F.lit("s"), text.stars_of(v).cast("string")), number)
    date = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.lit("d"), F.try_to_date(v, "yyyy-MM-dd").cast("string")))
    colour = F.when(v.rlike("^0x[0-9A-Fa-f]{6}$"), F.lower(v))
    address = names.upcase(text.nfc(F.replace(text.location_decode(v), F.lit("\\"), F.lit("/"))))
    return (
        F.when(field.isin(*NUMBERS), F.coalesce(number, unread))
        .when(field.isin(*DATES), F.coalesce(date, unread))
        .when(field == "Rating", F.coalesce(stars, unread))
        .when(field == "Colour", F.coalesce(colour, unread))
        .when(field == "Location", F.when(v != "", address))
        .when(field_kind(field) != "value", unread)
        .otherwise(F.when(F.trim(v) != "", text.nfc(v)))
    )


def handling(decision: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in HANDLING.items() for x in p]), decision)


NAMES = ("app", "external", "base", "replaced")
#: Tasks that put together what one task reads.
SHARES = 8


def sides(app: DataFrame, external: DataFrame, base: DataFrame, replaced: DataFrame, keys: tuple[str, str] = ("track", "field")) -> DataFrame:
    """(track, field, app, external, base, replaced): what each of four tables (track, field, value) says, null where it says nothing; of several rows of a field the least value."""
    rows = functools.reduce(DataFrame.union, [side.select(*keys, F.lit(name).alias("side"), "value") for name, side in zip(NAMES, (app, external, base, replaced))])
    return sides_of(rows, keys)


def sides_of(rows: DataFrame, keys: tuple[str, str] = ("track", "field")) -> DataFrame:
    """``sides`` of one table (track, field, side, value).

    Rows are dealt by track once, as they are; the fields are put together there, in one sort
    that the joins by track behind it use as well. What one task sorts is a fixed share of one
    part of the input, whose parts Spark bounds, so it does not grow with the table.
    """
    rows = rows.select(*keys, F.col("side").alias("side__"), "value")
    dealt = rows.repartition(SHARES * rows.rdd.getNumPartitions(), keys[0])
    return dealt.groupBy(*keys).agg(*(F.min(F.when(F.col("side__") == name, F.col("value"))).alias(name) for name in NAMES))


def detect(all_sides: DataFrame, entries: DataFrame | None = None, derived: DataFrame | None = None, keys: tuple[str, str] = ("track", "field")) -> DataFrame:
    """``sides`` with the decision of the merge table on comparison keys, and its handling.

    ``entries(track, stale)`` are the tracks that the other side has, stale if their row was
    kept from an older read; without it a track is there if the field has a value. ``derived(track,
    field)`` are the app's values that were worked out and not given. A side that says nothing
    is not a blank value: no app value takes the other's, no base was never sent, and what a
    send replaced is unknown if null.
    """
    rows = all_sides
    track, field = (F.col(k) for k in keys)
    if entries is not None:
        own = entries.groupBy(F.col(keys[0]).alias("track__")).agg(F.max(F.coalesce("stale", F.lit(False))).alias("stale__"))
        rows = rows.join(own, track == F.col("track__"), "left").withColumn("there__", F.col("track__").isNotNull()).drop("track__")
    else:
        rows = rows.withColumns({"stale__": F.lit(False), "there__": F.col("external").isNotNull()})
    if derived is not None:
        own = derived.groupBy(F.col(keys[0]).alias("track__")).agg(F.collect_set(keys[1]).alias("fields__"))
        rows = rows.join(own, track == F.col("track__"), "left").withColumn("derived__", F.coalesce(F.array_contains("fields__", field), F.lit(False))).drop("track__", "fields__")
    else:
        rows = rows.withColumn("derived__", F.lit(False))
    said = lambda c: F.lit(True) if c == "external" else F.col(c).isNotNull()
    keyed = rows.withColumns({f"{c}__": F.when(said(c), F.coalesce(comparison_key(field, F.col(c)), F.lit(""))) for c in NAMES})
    decided = decisions.merge_decision(field_kind(field), *(F.col(f"{c}__") for c in NAMES), F.col("there__"), F.coalesce("stale__", F.lit(False)), F.col("derived__"))
    out = keyed.withColumn("decision", decided).withColumn("handling", handling(F.col("decision")))
    return out.drop("stale__", "there__", "derived__", *(f"{c}__" for c in NAMES))


def sync(found: DataFrame, opened: DataFrame, keys: tuple[str, str] = ("track", "field")) -> DataFrame:
    """(track, field, change): what becomes of the table of open conflicts: opened, kept or closed."""
    now = found.where("handling = 'review'").select(*keys, F.lit(True).alias("now"))
    was = opened.select(*keys, F.lit(True).alias("was"))
    both = now.join(was, list(keys), "full")
    return both.select(*keys, F.when(F.col("was").isNull(), "opened").when(F.col("now").isNull(), "closed").otherwise("kept").alias("change"))


def open_by_field(found: DataFrame) -> DataFrame:
    return found.where("handling = 'review'").groupBy("field").agg(F.count("*").alias("n"))


def resolve(found: DataFrame, choices: DataFrame) -> DataFrame:
    """(track, field, value, sent): conflicts that ``choices(track, field, choice, edit)`` settle: keep app, keep external, or an edit.

    What is sent to the other side is the value that stands, unless that side has it.
    """
    rows = found.where("handling = 'review'").join(choices, ["track", "field"])
    value = F.when(F.col("choice") == "app", F.col("app")).when(F.col("choice") == "external", F.col("external")).otherwise(F.col("edit"))
    same = comparison_key(F.col("field"), value).eqNullSafe(comparison_key(F.col("field"), F.col("external")))
    return rows.select("track", "field", value.alias("value"), (~same).alias("sent"))


def stale_playlists(read: DataFrame, app: DataFrame, recorded: DataFrame) -> DataFrame:
    """The playlists of ``read(path)`` that were sent (``recorded(path)``) and that ``app(path)`` lacks; letter case does not count."""
    key = F.lower(F.rtrim("path")).alias("path__")
    rows = read.withColumn("path__", key)
    rows = rows.join(recorded.select(key).distinct(), "path__", "left_semi").join(app.select(key).distinct(), "path__", "left_anti")
    return rows.drop("path__")


def manual_removals(removed: DataFrame, replaced: DataFrame, held: DataFrame) -> DataFrame:
    """(location, why) to take away by hand: removed tracks' entries that ``held(location)`` still has, then replaced ones not listed yet."""
    gone = removed.select("location", F.lit("removed").alias("why"), F.lit(0).alias("o")).distinct()
    left = replaced.select("location", F.lit("replaced").alias("why"), F.lit(1).alias("o")).distinct()
    rows = gone.union(left).join(held.select("location").distinct(), "location", "left_semi")
    return rows.groupBy("location").agg(F.min_by("why", "o").alias("why"))


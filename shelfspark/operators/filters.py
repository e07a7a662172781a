"""Filters of the list query and rules of smart collections, compiled to Columns."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import music, text

# Bits of a row's flags.
IN_LIBRARY, HAS_FILE, MISSING, LOW_QUALITY, EXTERNAL, IN_CRATE, NO_TAGS, NO_ART, ENERGY = 1, 2, 4, 8, 16, 32, 64, 128, 0xF00
MOST_CONDITIONS = 32


def _bit(bit: int, want: bool = True) -> Column:
    has = F.col("flags").bitwiseAND(bit)
    return has != 0 if want else has == 0


FILTERS: dict[str, Callable[[dict], Column]] = {
    "missing": lambda f: _bit(MISSING),
    "inExternal": lambda f: _bit(EXTERNAL),
    "notInExternal": lambda f: _bit(EXTERNAL, False),
    "inCrate": lambda f: _bit(IN_CRATE),
    "inNoCrate": lambda f: _bit(IN_CRATE, False),
    "inLibrary": lambda f: _bit(IN_LIBRARY),
    "notInLibrary": lambda f: _bit(IN_LIBRARY, False),
    "lowQuality": lambda f: _bit(LOW_QUALITY),
    "qualityProblem": lambda f: _bit(LOW_QUALITY) & _bit(HAS_FILE),
    "analyzed": lambda f: F.col("bpm").isNotNull() & F.col("key_order").isNotNull(),
    "notAnalyzed": lambda f: F.col("bpm").isNull() | F.col("key_order").isNull(),
    "missingTags": lambda f: _bit(NO_TAGS),
    "missingArt": lambda f: _bit(NO_ART),
    "energy": lambda f: (F.col("flags").bitwiseAND(ENERGY) == f["level"] << 8) if 1 <= f["level"] <= 10 else F.lit(False),
    "noEnergy": lambda f: _bit(IN_LIBRARY) & _bit(ENERGY, False),
    "genre": lambda f: text.genre_group(F.col("genre")) == f["genre"].strip().lower(),
    "tag": lambda f: F.array_contains("tags", f["tag"]),
}


def condition(filters: list[dict[str, Any]]) -> Column:
    """All filters together; alternatives among ``format`` filters."""
    formats = sorted({f["format"] for f in filters if f["kind"] == "format"})
    out = [FILTERS[f["kind"]](f) for f in filters if f["kind"] != "format"]
    if formats:
        out.append(F.col("format").isin(formats))
    return functools.reduce(lambda a, b: a & b, out, F.lit(True))


def _numbers(x: Column, op: str, value: float, to: float | None) -> Column:
    low, high = sorted((value, value if to is None else to))
    return {"is": x == value, "isNot": x != value, "atLeast": x >= value, "atMost": x <= value, "between": x.between(low, high)}[op]


def _bpm(op: str, value: float, to: float | None, half_double: bool) -> Column:
    low, high = sorted((value, value if to is None else to))
    low, high = {"atLeast": (value - 0.5, None), "atMost": (None, value + 0.5), "between": (low - 0.5, high + 0.5)}.get(op, (value - 0.5, value + 0.5))
    x, out = F.col("bpm"), F.lit(False)
    for k in (1.0, 0.5, 2.0) if half_double else (1.0,):
        part = F.lit(True)
        if low is not None:
            part &= x >= low * k
        if high is not None:
            part &= x < high * k
        out |= part
    return ~out if op == "isNot" else out


def _one(c: dict[str, Any]) -> Column:
    field, op, value, to = c["field"], c["op"], c.get("value"), c.get("to")
    if field == "bpm":
        return _bpm(op, value, to, c.get("halfDouble", False)) & F.col("bpm").isNotNull()
    if field in ("energy", "rating"):
        x = F.nullif(F.col(field), F.lit(0))
        return _numbers(x, op, value, to)
    if field == "key":
        same = F.col("key_order") == music.key_order(F.lit(value))
        return same if op == "is" else ~same
    if field == "genre":
        group, want = text.genre_group(F.col("genre")), value.strip().lower()
        if op == "contains":
            return F.instr(group, want) > 0 if want else F.lit(False)
        return group == want if op == "is" else group != want
    if field == "inCrate":
        return _bit(IN_CRATE, op == "is")
    if field == "tag":
        has = F.coalesce(F.array_contains("tags", value), F.lit(False))
        if op == "has":
            return has
        # a tag that does not exist matches nothing, either way
        return F.array_contains("known_tags", value) & ~has
    if field == "inExternal":
        return _bit(EXTERNAL, op == "is")
    raise ValueError(f"no such field: {field}")


def rule(r: dict[str, Any]) -> Column:
    """A smart rule ``{combine: all|any, conditions}``; without conditions nothing matches, nor does a missing value.

    Conditions on tags read the columns ``tags`` (the row's) and ``known_tags`` (all that exist).
    """
    parts = [F.coalesce(_one(c), F.lit(False)) for c in r["conditions"]]
    if len(parts) > MOST_CONDITIONS:
        raise ValueError(f"more than {MOST_CONDITIONS} conditions")
    if not parts:
        return F.lit(False)
    return functools.reduce((lambda a, b: a & b) if r["combine"] == "all" else (lambda a, b: a | b), parts)

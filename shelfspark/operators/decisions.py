"""Decision tables as ordered conditions: quality, pair outcomes, three-way merges and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the quality verdict.
LOW_KBPS, MP3_KBPS, MP3_CUTOFF, LOSSLESS_CUTOFF = 190, 254, 17_000, 19_500
# The pair table, one row a case: audio cases, name relations, outcome.
#: ``artists``: one title, and the artists differ.
PAIR_TABLE = (
    ("identical", "*", "duplicate"),
    ("full", "same", "duplicate"),
    ("full", "artists", "duplicate"),
    ("full", "cut", "cut"),
    ("full", "rework", "review"),
    ("full", "unclear", "review"),
    ("full", "mashup", "review"),
    ("inside", "same", "cut"),
    ("inside", "artists", "cut"),
    ("inside", "cut", "cut"),
    ("inside", "unclear", "cut"),
    ("inside", "rework", "review"),
    ("inside", "title", "review"),
    ("inside partial", "mashup", "rework"),
    ("partial", "same", "review"),
    ("partial", "unclear", "review"),
    ("partial", "artists", "review"),
    ("partial none uncompared unknown", "cut", "cut"),
    ("partial none uncompared unknown", "rework", "rework"),
    ("none", "same", "different"),
    ("uncompared", "same", "review"),
    ("unknown", "same", "review"),
    ("none uncompared unknown", "artists", "different"),
    ("none uncompared unknown", "mashup", "different"),
    ("none uncompared unknown", "unclear", "different"),
    ("partial none uncompared unknown", "title", "different"),
)


def is_short(decoded_ms: Column, header_ms: Column) -> Column:
    """Whether more than two seconds and one percent are missing, in whole numbers."""
    lost = header_ms - decoded_ms
    return (lost > 2000) & (lost * 100 > header_ms)


def audio_case(identical: Column, cover_a: Column, cover_b: Column, score: Column) -> Column:
    """How two fingerprints relate, from how much of each the other covers and the mean difference."""
    compared = cover_a.isNotNull() & cover_b.isNotNull() & score.isNotNull()
    good = score <= 4
    return (
        F.when(identical, "identical")
        .when(~compared, "uncompared")
        .when(good & (cover_a >= 0.9) & (cover_b >= 0.9), "full")
        .when(good & ((cover_a >= 0.9) | (cover_b >= 0.9)), "inside")
        .when((cover_a > 0) | (cover_b > 0), "partial")
        .otherwise("none")
    )


def pair_outcome(audio: Column, names: Column, truncated: Column, labels: Column) -> Column:
    """Outcome of a pair: the first row of the table that applies, after two exceptions.

    ``labels`` is what the version labels alone say (same, cut, rework or null). Under another
    title with full audio they decide; with one file inside the other they do so if they name
    a cut or a rework. A cut-off copy of the same name, the artists agreeing, is a duplicate.
    """
    says = (audio == "full") & labels.isNotNull() | (audio == "inside") & labels.isin("cut", "rework")
    relation = F.when((names == "title") & F.coalesce(says, F.lit(False)), labels).otherwise(names)
    out = F.when((audio == "inside") & (names == "same") & truncated, "duplicate")
    for cases, relations, outcome in PAIR_TABLE:
        fits = audio.isin(cases.split())
        out = out.when(fits if relations == "*" else fits & (relation == relations), outcome)
    return out.otherwise("review")


def quality(codec: Column, lossless: Column, kbps: Column, cutoff_hz: Column, sample_rate: Column, decode_errors: Column, decoded_ms: Column, header_ms: Column) -> Column:
    """broken > truncated > transcode > lowBitrate > ok; null if nothing was measured and nothing flagged."""
    line = F.when(lossless, LOSSLESS_CUTOFF).when((codec == "mp3") & (kbps >= MP3_KBPS), MP3_CUTOFF)
    transcode = (cutoff_hz < line) & (sample_rate / 2 > line)
    return (
        F.when(decode_errors > 0, "broken")
        .when(is_short(decoded_ms, header_ms), "truncated")
        .when(transcode, "transcode")
        .when(~lossless & (kbps < LOW_KBPS), "lowBitrate")
        .when(cutoff_hz.isNotNull(), "ok")
    )


def merge_decision(field: Column, app: Column, external: Column, base: Column, replaced: Column, there: Column, stale: Column, derived: Column) -> Column:
    """What becomes of one field of a record that is kept in two places, given the value last sent."""
    same = app.eqNullSafe(external)
    app_moved, ext_moved = ~app.eqNullSafe(base), ~external.eqNullSafe(base)
    back = external.eqNullSafe(replaced)
    first = F.when(same, "same").when(back, "send").otherwise("conflict")
    return (
        F.when(field.isin("analysis", "id"), "never")
        .when(stale, "wait")
        .when(~there, "send")
        .when(app.isNull(), "take")
        .when(base.isNull(), first)
        .when(~ext_moved, F.when(app_moved, "send").otherwise("same"))
        .when(~app_moved, F.when(back, "notTakenUp").when(derived, "review").otherwise("take"))
        .otherwise(F.when(same, "same").otherwise("conflict"))
    )


def inbox_label(decided: Column, in_library: Column, better: Column, link: Column) -> Column:
    """Label of an arrival: checking, already, better, otherCut, rework or new."""
    return (
        F.when(~decided, "checking")
        .when(in_library & better, "better")
        .when(in_library, "already")
        .when(link == "cut", "otherCut")
        .when(link == "rework", "rework")
        .otherwise("new")
    )


def skip_reason(kind: Column, location: Column) -> Column:
    """Why an external entry is not taken in; null if it is."""
    return F.when(kind.isin("demo", "sampler"), kind).when(location.isNull() | (F.trim(location) == ""), "deleted").when(location.rlike("^(soundcloud|tidal|beatport|https?):"), "streaming")


def _path_parts(path: Column) -> Column:
    """A path's parts in upper case; a long-path prefix, empty parts and single dots do not count."""
    bare = F.regexp_replace(F.regexp_replace(path, r"(?i)^\\\\\?\\UNC\\", ""), r"^\\\\\?\\", "")
    return F.transform(F.filter(F.split(bare, r"[\\/]"), lambda p: (p != "") & (p != ".")), lambda p: F.upper(p))


def fragile(path: Column, kind: Column, downloads: str, temp: list[str]) -> Column:
    """Why a file may not stay where it is: downloads, temp, external or network; null if it may.

    A folder holds what begins with its parts, whatever their letter case; one of fewer than two parts holds nothing.
    """

    def inside(folder: str) -> Column:
        own = [p.upper() for p in folder.replace("\\", "/").split("/") if p not in ("", ".")]
        return F.slice(_path_parts(path), 1, len(own)) == F.array(*map(F.lit, own)) if len(own) >= 2 else F.lit(False)

    in_temp = F.lit(False)
    for folder in temp:
        in_temp = in_temp | inside(folder)
    return F.when(inside(downloads), "downloads").when(in_temp, "temp").when(kind.isin("external", "network"), kind)

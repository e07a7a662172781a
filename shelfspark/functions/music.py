"""Keys, tempi and energy as Column factories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least tempo steps in BPM and their points or fitness.
TEMPO_POINTS = ((2.0, 3), (4.0, 2), (8.0, 1))
WIDE_TEMPO = ((3.0, 1.0), (6.0, 0.75), (12.0, 0.5), (20.0, 0.25))
WIDE_STEPS = (1.0, 0.75, 0.5, 0.25)
TIGHT_STEPS = (1.0, 0.5)
# Major and minor keys of the wheel by number, in classical names.
MINOR = "Abm Ebm Bbm Fm Cm Gm Dm Am Em Bm F#m Dbm".split()
MAJOR = "B F# Db Ab Eb Bb F C G D A E".split()
ENHARMONIC = {"G#": "Ab", "D#": "Eb", "A#": "Bb", "C#": "Db", "Gb": "F#", "Cb": "B", "Fb": "E", "E#": "F", "B#": "C"}


def key_order(key: Column) -> Column:
    """Place on the wheel of a key written 8A, 08a or 12B: 1A is 2, 1B 3, ... 12B 25; null for anything else."""
    number = F.regexp_extract(key, r"^\s*0*(\d{1,2})[ABab]\s*$", 1).try_cast("int")
    major = F.upper(F.trim(key)).endswith("B").cast("int")
    return F.when(number.between(1, 12), number * 2 + major)


def key_name(order: Column) -> Column:
    return F.concat((F.floor(order / 2)).cast("string"), F.when(order % 2 == 1, "B").otherwise("A"))


def any_key_order(key: Column) -> Column:
    """Place on the wheel of a key in wheel, Open Key (1m, 1d) or classical notation (Am, F# minor, Bb)."""
    opened = F.regexp_extract(key, r"^\s*(\d{1,2})\s*[mdMD]\s*$", 1).try_cast("int")
    number = F.pmod(opened + F.lit(6), F.lit(12)) + 1
    from_open = F.when(opened.between(1, 12), number * 2 + F.lower(F.trim(key)).endswith("d").cast("int"))
    root = F.initcap(F.regexp_extract(key, r"^\s*([A-Ga-g][#b♯♭]?)\s*(?:m|min|minor|maj|major)?\s*$", 1))
    root = F.translate(root, "♯♭", "#b")
    same = F.create_map(*[F.lit(x) for p in ENHARMONIC.items() for x in p])
    root = F.coalesce(F.try_element_at(same, root), root)
    minor = F.trim(key).rlike(r"(?:m|[Mm]in|[Mm]inor)$") & ~F.trim(key).rlike(r"(?i)maj$")
    place = F.when(minor, F.array_position(F.array(*map(F.lit, MINOR)), F.concat(root, F.lit("m"))) * 2)
    place = place.otherwise(F.array_position(F.array(*map(F.lit, MAJOR)), root) * 2 + 1)
    return F.coalesce(key_order(key), from_open, F.when(place > 1, place).cast("int"))


def steps_apart(a: Column, b: Column) -> Column:
    """Steps round the wheel between the numbers of two places, the short way."""
    apart = F.abs(F.floor(a / 2) - F.floor(b / 2))
    return F.least(apart, 12 - apart)


def key_relation(a: Column, b: Column) -> Column:
    return relation_of(steps_apart(a, b), (a % 2) == (b % 2))


def relation_of(steps: Column, same: Column) -> Column:
    """How two keys relate, by the steps between their numbers and whether both are minor or major."""
    return (
        F.when((steps == 0) & same, "same")
        .when((steps == 1) & same, "adjacent")
        .when((steps == 0) & ~same, "relative")
        .when((steps == 2) & same, "two")
        .when((steps == 1) & ~same, "diagonal")
        .when(steps.isNotNull() & same.isNotNull(), "far")
    )


def key_fitness(a: Column, b: Column, wide: bool = False) -> Column:
    return relation_fitness(key_relation(a, b), wide)


def relation_fitness(r: Column, wide: bool = False) -> Column:
    near = F.when(r == "same", 1.0).when(r.isin("adjacent", "relative"), 0.8 if wide else 2.0 / 3.0)
    if wide:
        near = near.when(r == "two", 0.5).when(r == "diagonal", 0.4)
    return near.when(r.isNotNull(), 0.0)


def tempo_gap(target: Column, bpm: Column) -> Column:
    """Difference of a tempo from the target's, read straight, doubled or halved, whichever is nearest (straight on a tie)."""
    gaps = F.array(*(F.struct(F.abs(bpm * k - target).alias("far"), F.lit(i).alias("i"), (bpm * k - target).alias("gap")) for i, k in enumerate((1.0, 2.0, 0.5))))
    return F.when(target.isNotNull() & bpm.isNotNull(), F.array_min(gaps)["gap"])


def _stepped(x: Column, steps: tuple[tuple[float, float], ...]) -> Column:
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for most, value in steps:
        out = out.when(x <= most, float(value))
    return out.otherwise(0.0)


def tempo_points(gap: Column) -> Column:
    return F.coalesce(_stepped(F.abs(gap), TEMPO_POINTS), F.lit(0.0)).cast("int")


def tempo_fitness(gap: Column, wide: bool = False) -> Column:
    return _stepped(F.abs(gap), WIDE_TEMPO if wide else tuple((a, b / 3.0) for a, b in TEMPO_POINTS))


def energy_fitness(step: Column, ideal: int = 0, wide: bool = False) -> Column:
    return _stepped(F.abs(step - ideal), tuple((float(k), x) for k, x in enumerate(WIDE_STEPS if wide else TIGHT_STEPS)))


def time_ms(total_s: Column, duration_ms: Column) -> Column:
    """Whole seconds of the external entry if it has any, else the file's length."""
    return F.coalesce(F.when(total_s > 0, total_s * 1000), duration_ms).cast("long")


def duration_fits(total_s: Column, duration_ms: Column) -> Column:
    return (duration_ms >= total_s * 1000 - 500) & (duration_ms < total_s * 1000 + 1500)


def about_as_long(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1000, F.lit(False))


def energy_bits(level: Column) -> Column:
    return F.shiftleft(F.coalesce(level, F.lit(0)).cast("long"), 8)


def energy_of(flags: Column) -> Column:
    return F.shiftright(flags.bitwiseAND(0xF00), 8)

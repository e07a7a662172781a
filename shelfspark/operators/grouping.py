"""Which files are one track: sets joined by evidence, held apart by decisions, and kept current piece by piece.

Files of a track, and each file without one, are a node. Nodes are joined in two steps, by
the very same audio and then by pairs found to be duplicates, and a set merges only as a
whole. All checks are sums over groups; no pair of files is made that was not given, and what
a decision says of two audios is kept for their holders as classes, not pair by pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.graph import connected_components
from shelfspark.storage import stored

MOST_FILES = 50


def _flag(c: str) -> Column:
    return F.coalesce(F.max(c), F.lit(False))


def _settled(sets: DataFrame, forbidden: DataFrame, verdict: Column) -> DataFrame:
    """(set, verdict) of ``sets(set, mine, ...)``: library tracks and given separations hold a set whatever its pairs say."""
    held = forbidden.groupBy("set").agg(F.min("why").alias("why"))
    first = F.when(F.col("mine") >= 2, "library").when(F.col("why").isNotNull(), F.substring("why", 2, 20))
    return sets.join(held, "set", "left").select("set", F.coalesce(first, verdict).alias("verdict"))


def _across(ends: DataFrame, at: DataFrame, why: Column) -> DataFrame:
    """(set, why): pairs of nodes ``ends(x, y)`` in one set but different units of ``at(node, unit, set)``."""
    x, y = (at.select(F.col("node").alias(c), F.col("unit").alias(f"unit_{c}"), F.col("set").alias(f"set_{c}")) for c in "xy")
    return ends.join(x, "x").join(y, "y").where("set_x = set_y AND unit_x <> unit_y").select(F.col("set_x").alias("set"), why.alias("why"))


def _tokens(holders: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, token, ...) and (ta, tb) of ``holders(node, key, library)`` and decisions: which nodes they are about.

    A token is an audio, or an audio as library nodes hold it: an audio set apart from itself,
    or the same as itself, speaks of library tracks.
    """
    own = F.array(F.concat(F.lit("k"), "key"), F.concat(F.when(F.col("library"), "l"), "key"))
    held = holders.withColumn("token", F.explode(F.array_compact(own))).drop("key", "library").distinct()
    kind = F.when(F.col("key_a") == F.col("key_b"), "l").otherwise("k")
    named = decisions.where("key_a IS NOT NULL AND key_b IS NOT NULL").select(F.concat(kind, "key_a").alias("ta"), F.concat(kind, "key_b").alias("tb"))
    named = named.unionByName(named.select(F.col("tb").alias("ta"), F.col("ta").alias("tb"))).distinct()
    return held.join(named.select(F.col("ta").alias("token")).distinct(), "token", "left_semi"), named


def _called(ends: DataFrame, held: DataFrame, named: DataFrame) -> DataFrame:
    """Those of ``ends(x, y)``, x <> y, that a decision names."""
    met = ends.join(held.select(F.col("node").alias("x"), F.col("token").alias("ta")), "x").join(named, "ta")
    return met.join(held.select(F.col("node").alias("y"), F.col("token").alias("tb")), ["y", "tb"]).select("x", "y").distinct()


def _named_across(held: DataFrame, named: DataFrame, at: DataFrame, why: Column) -> DataFrame:
    """(set, why): sets with nodes in two different units that a decision names, by the least and largest unit of each token."""
    units = held.join(at.select("node", "unit", "set"), "node").groupBy("set", "token").agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    a, b = (units.select("set", F.col("token").alias(f"t{c}"), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}")) for c in "ab")
    both = a.join(named, "ta").join(b, ["set", "tb"]).where("least(low_a, low_b) <> greatest(high_a, high_b)")
    return both.select("set", why.alias("why")).distinct()


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, set): each node of ``nodes(node)`` and the least one it reaches."""
    found = connected_components(edges, "x", "y").withColumnRenamed("component", "set")
    return nodes.join(found, "node", "left").select("node", F.coalesce("set", "node").alias("set"))


def plan(members: DataFrame, pairs: DataFrame, apart: DataFrame, same: DataFrame, links: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(file, node, unit, set, verdict): where each file stands and whether its set merges.

    ``members(file, track, key, library)``: track and key (its audio) may be null; a file
    is a node of its own without a track. ``pairs(a, b, outcome)``, a < b, outcomes
    duplicate, undecided and anything else (they differ). ``apart`` and ``same``
    (key_a, key_b) are decisions about two audios, ``links(track_a, track_b)`` tracks that
    are versions of each other.

    Nodes that hold one audio, the same one, are a unit, unless two of them are in the
    library, linked or apart. Sets are units joined by a shared audio, a duplicate pair or a
    ``same``. A set's verdict: ``single`` (one unit), ``library`` (two library units),
    ``linked`` or ``apart`` (across its units), ``merge`` (every pair of its files in two units
    is a duplicate, has one audio or was called the same; ``most`` files at most unless all
    have one audio), ``differ`` (some pair is not a duplicate, or too many files), else ``wait``.
    Links give way to ``same``.
    """
    own = members.withColumn("node", F.coalesce(F.col("track").cast("long"), -F.col("file").cast("long") - 1))
    own = stored(own.select("file", "node", "key", F.coalesce("library", F.lit(False)).alias("library")), "group-members")
    nodes = stored(
        own.groupBy("node").agg(F.max("library").alias("library"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"), F.count("key").alias("keyed")),
        "group-nodes",
    )
    holders = own.where("key IS NOT NULL").select("key", "node").distinct().join(nodes.select("node", "library"), "node")
    (apart_held, apart_named), (same_held, same_named) = (tuple(stored(x, "group-decided") for x in _tokens(holders, d)) for d in (apart, same))
    linked = links.select(F.least("track_a", "track_b").cast("long").alias("x"), F.greatest("track_a", "track_b").cast("long").alias("y")).distinct()
    linked = stored(linked.join(_called(linked, same_held, same_named), ["x", "y"], "left_anti"), "group-linked")
    separations = lambda at: _across(linked, at, F.lit("1linked")).unionByName(_named_across(apart_held, apart_named, at, F.lit("2apart")))

    # 1. nodes that hold one audio, the same one
    one = nodes.where("keyed = n AND low = high").select("node", F.col("low").alias("key"))
    first = one.groupBy("key").agg(F.min("node").alias("set")).join(one, "key").select("node", "set")
    at = nodes.join(first, "node", "left").select("node", "library", F.col("node").alias("unit"), F.coalesce("set", "node").alias("set"))
    sets = at.groupBy("set").agg(F.count(F.when(F.col("library"), 1)).alias("mine"))
    held = _settled(sets, separations(at), F.lit("merge"))
    units = stored(at.join(held, "set").select("node", "library", F.when(F.col("verdict") == "merge", F.col("set")).otherwise(F.col("node")).alias("unit")), "group-units")

    # 2. units joined by a shared audio, duplicate pairs and decisions
    of_file = own.join(units.select("node", "unit"), "node").select("file", "node", "unit", "key", "library")
    of_file = stored(of_file, "group-files")
    a, b = (of_file.select(F.col("file").alias(c), F.col("unit").alias(f"unit_{c}"), F.col("key").alias(f"key_{c}")) for c in "ab")
    given = stored(pairs.select("a", "b", "outcome").join(a, "a").join(b, "b").where("unit_a <> unit_b"), "group-pairs")
    # units of which the decisions say the same are a class; what they join is pairs of classes
    tokens = same_held.join(units.select("node", "unit"), "node").select("unit", "token").distinct()
    kinds = stored(tokens.groupBy("unit").agg(F.array_sort(F.collect_set("token")).alias("class")), "group-classes")
    spoken = stored(kinds.select("class", F.col("class").alias("tokens")).distinct().select("class", F.explode("tokens").alias("token")), "group-tokens")
    alike_classes = spoken.select(F.col("class").alias("class_x"), F.col("token").alias("ta")).join(same_named, "ta").join(spoken.select(F.col("class").alias("class_y"), F.col("token").alias("tb")), "tb")
    alike_classes = stored(alike_classes.select("class_x", "class_y").distinct(), "group-alike")
    # a star from the least unit of one side to all of the other joins what all pairs would
    ends = tokens.groupBy("token").agg(F.min("unit").alias("x"))
    by_same = tokens.select(F.col("unit").alias("y"), F.col("token").alias("ta")).join(same_named, "ta").join(ends.withColumnRenamed("token", "tb"), "tb").where("x <> y").select("x", "y")
    keyed = of_file.where("key IS NOT NULL").select("key", "unit").distinct()
    by_audio = keyed.groupBy("key").agg(F.min("unit").alias("x")).join(keyed, "key").select("x", F.col("unit").alias("y")).where("x <> y")
    edges = given.where("outcome = 'duplicate'").select(F.col("unit_a").alias("x"), F.col("unit_b").alias("y")).unionByName(by_audio).unionByName(by_same)
    spread = stored(_components(units.select(F.col("unit").alias("node")).distinct(), edges).withColumnRenamed("node", "unit"), "group-sets")
    whole = stored(of_file.join(spread, "unit"), "group-whole")

    n_of = whole.groupBy("set", "unit").agg(F.count("*").alias("n"), F.max("library").alias("library"))
    sizes = n_of.groupBy("set").agg(F.sum("n").alias("files"), F.count("*").alias("units"), F.sum(F.expr("n * (n - 1) div 2")).alias("within"), F.count(F.when(F.col("library"), 1)).alias("mine"))
    audio = whole.groupBy("set", "key", "unit").agg(F.count("*").alias("n"))
    # pairs of files in two units with one audio: all pairs with it, less those within units
    shared = audio.where("key IS NOT NULL").groupBy("set", "key").agg(F.expr("sum(n) * (sum(n) - 1) div 2 - sum(n * (n - 1) div 2)").alias("p"), F.sum("n").alias("n"))
    by_key = shared.groupBy("set").agg(F.sum("p").alias("same_audio"), F.count("*").alias("audios"), F.sum("n").alias("with_audio"))
    # files of two units called the same, less those of one audio: sums over classes of units
    of_class = lambda rows, by: rows.join(kinds, "unit").groupBy("set", "class", *by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    by_class, by_class_key = of_class(n_of, []), of_class(audio.where("key IS NOT NULL"), ["key"])
    two = lambda rows, by: rows.withColumnRenamed("class", "class_x").join(alike_classes, "class_x").where("class_x <= class_y").join(rows.select("set", *by, F.col("class").alias("class_y"), F.col("n").alias("ny")), ["set", *by, "class_y"])
    crossed = F.when(F.col("class_x") == F.col("class_y"), F.expr("(n * n - squares) div 2")).otherwise(F.col("n") * F.col("ny"))
    by_word = two(by_class, []).select("set", crossed.alias("p")).unionByName(two(by_class_key, ["key"]).select("set", (-crossed).alias("p"))).groupBy("set").agg(F.sum("p").alias("called"))
    # given pairs that neither an audio nor a decision settles
    left = given.where("NOT coalesce(key_a = key_b, false)").select("outcome", F.col("unit_a").alias("x"), F.col("unit_b").alias("y"))
    for c in "xy":
        left = left.join(kinds.select(F.col("unit").alias(c), F.col("class").alias(f"class_{c}")), c, "left")
    left = left.join(alike_classes, ["class_x", "class_y"], "left_anti").join(spread.withColumnRenamed("unit", "x"), "x").join(spread.select(F.col("unit").alias("y"), F.col("set").alias("set_y")), "y").where("set = set_y")
    said = left.groupBy("set").agg(F.count(F.when(F.col("outcome") == "duplicate", 1)).alias("dup"), F.count(F.when(~F.col("outcome").isin("duplicate", "undecided"), 1)).alias("bad"))

    sums = reduce(lambda x, y: x.join(y, "set", "left"), [sizes, by_key, by_word, said])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cross = F.expr("files * (files - 1) div 2") - F.col("within")
    one_audio = (zero("audios") == 1) & (zero("with_audio") == F.col("files"))
    verdict = (
        F.when(one_audio, "merge")
        .when((F.col("files") > most) | (zero("bad") > 0), "differ")
        .when(zero("same_audio") + zero("called") + zero("dup") == cross, "merge")
        .otherwise("wait")
    )
    at = units.join(spread, "unit").select("node", "unit", "set")
    answers = _settled(sums.withColumn("own", verdict), separations(at), F.col("own"))
    answers = answers.join(sizes.select("set", "units"), "set").select("set", F.when(F.col("units") == 1, "single").otherwise(F.col("verdict")).alias("verdict"))
    return whole.join(answers, "set").select("file", "node", "unit", "set", "verdict")


def destinations(members: DataFrame, planned: DataFrame) -> DataFrame:
    """(file, track): where files go; a library track first, then the lowest one; null stands for a new track, with its least file.

    Files of a set that merges go together, others with their unit.
    """
    own = members.select("file", "track", F.coalesce("library", F.lit(False)).alias("library")).join(planned, "file")
    own = own.withColumn("goal", F.when(F.col("verdict") == "merge", F.col("set")).otherwise(F.col("unit")))
    best = own.groupBy("goal").agg(F.min(F.when(F.col("track").isNotNull(), F.struct(~F.col("library"), "track"))).alias("to"), F.min("file").alias("least"))
    return own.join(best, "goal").select("file", F.col("to.track").alias("track"), F.when(F.col("to").isNull(), F.col("least")).alias("new_with"))


def touched_files(before: DataFrame, after: DataFrame, key: list[str], files: list[str]) -> DataFrame:
    """(file): files named by rows that are new, gone or changed between two tables with ``key``; ``files`` are its columns."""
    rest = [c for c in after.columns if c not in key]
    rows = lambda t, side: t.select(*key, F.struct(*(rest or [F.lit(1)])).alias("rest"), F.lit(side).alias("side"))
    both = rows(before, 0).unionByName(rows(after, 1)).groupBy(*key)
    moved = both.agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.count("*").alias("n")).where("n <> 2 OR NOT (low <=> high)")
    named = F.array(*(F.col(c) for c in files))
    return moved.select(F.explode(named).alias("file")).distinct()


def replan(stored_plan: DataFrame, touched: DataFrame, members: DataFrame, pairs: DataFrame, apart: DataFrame, same: DataFrame, links: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """The plan after a change, worked out anew only for the sets that ``touched(file)`` concerns.

    Touched are the files of new, gone or changed members and pairs (see ``touched_files``),
    and of the tracks or audios a changed link or decision names. With them go the files of
    their sets, and of sets that now share an audio or a track with one of them; what joins
    two sets has a touched file at one end at least, so nothing else can change.
    """
    now = members.select("file", "track", "key")
    near = touched.select("file").distinct()
    changed = now.join(near, "file", "left_semi")
    by_audio = now.join(changed.where("key IS NOT NULL").select("key").distinct(), "key", "left_semi").select("file")
    by_track = now.join(changed.where("track IS NOT NULL").select("track").distinct(), "track", "left_semi").select("file")
    named = pairs.join(near.withColumnRenamed("file", "a"), "a", "left_semi").select(F.col("b").alias("file"))
    named = named.unionByName(pairs.join(near.withColumnRenamed("file", "b"), "b", "left_semi").select(F.col("a").alias("file")))
    near = stored(near.unionByName(by_audio).unionByName(by_track).unionByName(named).distinct(), "group-near")
    sets = stored_plan.join(near, "file", "left_semi").select("set").distinct()
    reach = stored(stored_plan.join(sets, "set", "left_semi").select("file").unionByName(near).distinct(), "group-reach")
    mine = members.join(reach, "file", "left_semi")
    within = pairs.join(reach.withColumnRenamed("file", "a"), "a", "left_semi").join(reach.withColumnRenamed("file", "b"), "b", "left_semi")
    fresh = plan(mine, within, apart, same, links, most)
    kept = stored_plan.join(reach, "file", "left_anti").join(now.select("file"), "file", "left_semi")
    return kept.unionByName(fresh)

"""Alignment of stored fingerprints: sequences of whole numbers, one for each eighth of a second or so.

Pairs come from equal numbers at any two places, by a join; each such meeting votes for the
offset between the two sequences. The main alignment of a pair is the offset with the most
items that match (differ in few bits); what it leaves on both sides is aligned again, up to a
bound.

The two sequences of a pair meet as lists, one row a pair, and all rounds of the pair are worked
out on these, so that items are shuffled for two joins and not several times in each round. Votes
are added up in steps of bounded size; no pair is held as a matrix. Pairs with a sequence of more
than ``HELD`` places are joined item by item instead: rows are items, votes and stretches.
Items are stored so densely that a few megabytes of file are many rows in memory, so their joins
are merge joins, and none of them is broadcast by the size of its files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.storage import bounded_batches, stored

#: A secondary stretch has so many items at least, and a pair so many alignments at most.
LEAST_ITEMS, MOST_ALIGNMENTS = 40, 8
#: Items match if fewer of their 32 bits differ; a pair without a match has the score of all bits.
MATCH_BITS, NO_MATCH = 10, 32.0
#: Offsets looked at for each pair and round, the most voted for first.
OFFSETS = 3
#: Places of a sequence that a task holds at most, and meetings of equal items that it adds up at once, about.
HELD, MEETINGS = 200_000, 1 << 20


def items(rows: DataFrame, id_col: str, values: Column) -> DataFrame:
    """(id, pos, item): one row for each number of each sequence."""
    return rows.select(F.col(id_col).alias("id"), F.posexplode(values).alias("pos", "item"))


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(0xFFFFFFFF)))


def _free(seq: DataFrame, taken: DataFrame, side: str) -> DataFrame:
    """Items of a pair's side that no stretch holds: (a, b, pos, item)."""
    spans = taken.select("a", "b", F.explode(F.sequence(F.col(f"start_{side}"), F.col(f"start_{side}") + F.col("items") - 1)).alias("pos"))
    return seq.join(spans.hint("merge"), ["a", "b", "pos"], "left_anti")


def _votes(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(a, b, shift): the offsets (place in a less place in b) with the most equal items, the least of equals first."""
    met = left.select("a", "b", "item", F.col("pos").alias("pa")).join(right.select("a", "b", "item", F.col("pos").alias("pb")).hint("merge"), ["a", "b", "item"])
    counted = met.groupBy("a", "b", (F.col("pa") - F.col("pb")).alias("shift")).agg(F.count("*").alias("votes"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("votes"), "shift"))
    return counted.withColumn("place", place).where(F.col("place") <= most).select("a", "b", "shift")


def _stretches(left: DataFrame, right: DataFrame, shifts: DataFrame, least: int) -> DataFrame:
    """(a, b, shift, start_a, start_b, items, bits): runs of matching items along each shift, ``least`` items or more."""
    a = left.join(shifts.hint("merge"), ["a", "b"]).select("a", "b", "shift", F.col("pos").alias("pa"), F.col("item").alias("ia"), (F.col("pos") - F.col("shift")).alias("pb"))
    met = a.join(right.select("a", "b", F.col("pos").alias("pb"), F.col("item").alias("ib")).hint("merge"), ["a", "b", "pb"])
    met = met.withColumn("bits", bits_apart(F.col("ia"), F.col("ib"))).where(F.col("bits") < MATCH_BITS)
    along = Window.partitionBy("a", "b", "shift").orderBy("pa")
    runs = met.withColumn("run", F.col("pa") - F.row_number().over(along))
    out = runs.groupBy("a", "b", "shift", "run").agg(F.min("pa").alias("start_a"), F.min("pb").alias("start_b"), F.count("*").alias("items"), F.sum("bits").alias("bits"))
    return out.where(F.col("items") >= least).drop("run")


def _by_rows(pairs: DataFrame, seq: DataFrame, least: int, most: int, first_least: int, offsets: int) -> DataFrame:
    """``align`` of different ``pairs``, item by item."""
    sides = []
    for c in "ab":
        sides.append(stored(pairs.join(seq.withColumnRenamed("id", c).hint("merge"), c).select("a", "b", "pos", "item"), f"align-{c}"))
    found = None
    for n in range(most):
        left, right = (sides if found is None else [_free(s, found, c) for s, c in zip(sides, "ab")])
        left, right = stored(left, "align-free"), stored(right, "align-free")
        shifts = _votes(left, right, offsets)
        runs = stored(_stretches(left, right, shifts, least if n else first_least), "align-runs")
        total = runs.groupBy("a", "b", "shift").agg(F.sum("items").alias("n"), F.sum("bits").alias("d"))
        best = total.groupBy("a", "b").agg(F.min(F.struct(-F.col("n"), F.col("d"), F.col("shift"))).alias("x")).select("a", "b", F.col("x.shift").alias("shift"))
        now = runs.join(best.hint("merge"), ["a", "b", "shift"]).select("a", "b", F.lit(n).alias("alignment"), "start_a", "start_b", "items", "bits")
        now = stored(now, "align-found")
        if now.isEmpty():
            break
        found = now if found is None else found.unionByName(now)
    return found if found is not None else now


def _voted(pa_: np.ndarray, ia: np.ndarray, pb: np.ndarray, ib: np.ndarray, most: int) -> np.ndarray:
    """The offsets with the most equal items, the least of equals first."""
    if not len(pa_) or not len(pb):
        return np.zeros(0, np.int64)
    order = np.argsort(ib, kind="stable")
    at = np.searchsorted(ib[order], ia)
    met = np.searchsorted(ib[order], ia, "right") - at
    low = pa_.min() - pb.max()
    votes, upto = np.zeros(pa_.max() - pb.min() - low + 1, np.int64), np.cumsum(met)
    cuts = np.searchsorted(upto, np.arange(0, upto[-1], MEETINGS))
    for k, end in zip(cuts, [*cuts[1:], len(pa_)]):
        n = met[k:end]
        place = np.arange(n.sum()) + np.repeat(at[k:end] - np.cumsum(n) + n, n)
        votes += np.bincount(np.repeat(pa_[k:end], n) - pb[order[place]] - low, minlength=len(votes))
    shifts = np.flatnonzero(votes)
    return shifts[np.lexsort((shifts, -votes[shifts]))[:most]] + low


def _runs(pa_: np.ndarray, ia: np.ndarray, pb: np.ndarray, ib: np.ndarray, shift: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in a, items and bits of the runs of matching items along an offset, ``least`` items or more."""
    at = np.minimum(np.searchsorted(pb, pa_ - shift), len(pb) - 1)
    bits = np.bitwise_count((ia ^ ib[at]) & 0xFFFFFFFF).astype(np.int64)
    ok = np.flatnonzero((pb[at] == pa_ - shift) & (bits < MATCH_BITS))
    begin = np.flatnonzero(np.diff(pa_[ok], prepend=-HELD * 2) != 1)
    size = np.diff(np.append(begin, len(ok)))
    differ = np.add.reduceat(bits[ok], begin) if len(ok) else size
    kept = size >= least
    return pa_[ok][begin][kept], size[kept], differ[kept]


def _pair(pa_: np.ndarray, ia: np.ndarray, pb: np.ndarray, ib: np.ndarray, least: int, most: int, first_least: int, offsets: int) -> Iterator[tuple[np.ndarray, ...]]:
    """start_a, start_b, items and bits of the stretches of each alignment of two sequences with rising places."""
    for n in range(most):
        found = []
        for shift in _voted(pa_, ia, pb, ib, offsets):
            start, size, differ = _runs(pa_, ia, pb, ib, shift, least if n else first_least)
            if len(start):
                found.append((-size.sum(), differ.sum(), shift, start, size, differ))
        if not found:
            break
        *_, shift, start, size, differ = min(found, key=lambda x: x[:3])
        yield start, start - shift, size, differ
        taken = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        left, right = np.isin(pa_, taken, invert=True), np.isin(pb, taken - shift, invert=True)
        pa_, ia, pb, ib = pa_[left], ia[left], pb[right], ib[right]


def _side(places: pa.Scalar, values: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Places and items that are not null."""
    own = values.values
    known = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
    at = places.values.to_numpy(zero_copy_only=False).astype(np.int64) if places.is_valid else np.arange(len(own))
    return at[known], own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[known]


def _by_lists(pairs: DataFrame, lists: DataFrame, least: int, most: int, first_least: int, offsets: int) -> DataFrame:
    """``align`` of different ``pairs`` of ``lists(id, places, items)``; places that are null count from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, level, parts = [], [], [[np.zeros(0, np.int64)] for _ in range(4)]
            for k, (pa_, ia, pb, ib) in enumerate(zip(*(b.column(c) for c in range(2, 6)))):
                for n, found in enumerate(_pair(*_side(pa_, ia), *_side(pb, ib), least, most, first_least, offsets)):
                    at += [k] * len(found[0])
                    level += [n] * len(found[0])
                    for part, x in zip(parts, found):
                        part.append(x)
            rows = pa.array(at, pa.int64())
            start_a, start_b, size, bits = map(np.concatenate, parts)
            columns = [b.column(0).take(rows), b.column(1).take(rows), pa.array(level, pa.int32()), pa.array(start_a).cast(kind), pa.array(start_b).cast(kind), pa.array(size), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    bounded_batches(pairs.sparkSession)
    place = lists.schema["places"].dataType.elementType
    kind = pa.int64() if place == T.LongType() else pa.int32()
    names = ["a", "b", "alignment", "start_a", "start_b", "items", "bits"]
    kinds = [pairs.schema["a"].dataType, pairs.schema["b"].dataType, T.IntegerType(), *(T.LongType() if kind == pa.int64() else T.IntegerType() for _ in "ab"), T.LongType(), T.LongType()]
    both = pairs
    for c in "ab":
        both = both.join(lists.select(F.col("id").alias(c), F.col("places").alias(f"places_{c}"), F.col("items").alias(f"items_{c}")).hint("merge"), c)
    both = both.select("a", "b", "places_a", "items_a", "places_b", "items_b")
    return both.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def _align(pairs: DataFrame, lists: DataFrame, seq: DataFrame, long: DataFrame, how: tuple[int, int, int, int]) -> DataFrame:
    """Different pairs with one of the ``long(id)`` sequences by their rows in ``seq``, the others by ``lists``."""
    if long.isEmpty():
        return _by_lists(pairs, lists, *how)
    far = long.select(F.col("id").alias("a")).withColumn("far_a", F.lit(True)), long.select(F.col("id").alias("b")).withColumn("far_b", F.lit(True))
    dealt = pairs.join(far[0], "a", "left").join(far[1], "b", "left").select("a", "b", F.coalesce("far_a", "far_b", F.lit(False)).alias("far"))
    dealt = stored(dealt, "align-dealt")
    near, rest = (dealt.where(x).select("a", "b") for x in ("NOT far", "far"))
    return _by_lists(near, lists, *how).unionByName(_by_rows(rest, seq, *how))


def align(pairs: DataFrame, seq: DataFrame, least: int = LEAST_ITEMS, most: int = MOST_ALIGNMENTS, first_least: int = 1, offsets: int = OFFSETS) -> DataFrame:
    """(a, b, alignment, start_a, start_b, items, bits): the stretches in which two sequences match.

    ``pairs(a, b)``; ``seq(id, pos, item)``, one item at a place. Alignment 0 is the one with the
    most matching items; each later one is the best in what the earlier ones left, of stretches of
    ``least`` items or more. No item of a side is in two stretches of a pair. ``bits`` is the
    number of differing bits over a stretch. Pairs without a match have no row. Items that are
    null match nothing.
    """
    known = seq.where("pos IS NOT NULL AND item IS NOT NULL")
    sizes = stored(known.groupBy("id").agg((F.max(F.abs("pos")) < HELD).alias("short")), "align-sizes")
    held = known.join(sizes.where("short").select("id").hint("merge"), "id", "left_semi")
    lists = held.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("s")).select("id", F.col("s.pos").alias("places"), F.col("s.item").alias("items"))
    return _align(pairs.select("a", "b").distinct(), lists, known, sizes.where("NOT short").select("id"), (least, most, first_least, offsets))


def align_lists(pairs: DataFrame, lists: DataFrame, least: int = LEAST_ITEMS, most: int = MOST_ALIGNMENTS, first_least: int = 1, offsets: int = OFFSETS) -> DataFrame:
    """``align`` of sequences that are each a row of ``lists(id, items)``, with places from 0."""
    pairs = stored(pairs.select("a", "b").distinct(), "align-pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    lists = stored(lists.select("id", "items").join(ends.hint("merge"), "id", "left_semi"), "align-lists")
    short = lists.where(F.size("items") <= HELD).select("id", F.lit(None).cast("array<int>").alias("places"), "items")
    return _align(pairs, short, items(lists, "id", F.col("items")), lists.where(F.size("items") > HELD).select("id"), (least, most, first_least, offsets))


def compared(pairs: DataFrame, seq: DataFrame, stretches: DataFrame) -> DataFrame:
    """(a, b, coverage_a, coverage_b, found_a, found_b, score): how two sequences line up.

    Coverage is the share of a side in the main alignment, found the share in any; the score
    is the mean of differing bits over the main alignment, 32 if nothing matched.
    """
    size = seq.groupBy("id").agg(F.count("*").alias("n"))
    sums = stretches.groupBy("a", "b").agg(
        F.sum(F.when(F.col("alignment") == 0, F.col("items"))).alias("main"), F.sum("items").alias("every"), F.sum(F.when(F.col("alignment") == 0, F.col("bits"))).alias("bits")
    )
    rows = pairs.select("a", "b").distinct().join(sums, ["a", "b"], "left")
    for c in "ab":
        rows = rows.join(size.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    share = lambda x, n: F.coalesce(F.col(x) / F.col(n), F.lit(0.0))
    return rows.select(
        "a", "b", share("main", "n_a").alias("coverage_a"), share("main", "n_b").alias("coverage_b"), share("every", "n_a").alias("found_a"), share("every", "n_b").alias("found_b"),
        F.coalesce(F.col("bits") / F.col("main"), F.lit(NO_MATCH)).alias("score"),
    )


def audio_case(found_a: Column, found_b: Column, coverage_a: Column, coverage_b: Column, score: Column, same: float = 0.9, part: float = 0.75, close: float = 5.0) -> Column:
    """same, a_within_b, b_within_a, overlap or none: what two sequences' alignment says of them."""
    return (
        F.when((coverage_a >= same) & (coverage_b >= same) & (score <= close), "same")
        .when((found_a >= part) & (found_b < part), "a_within_b")
        .when((found_b >= part) & (found_a < part), "b_within_a")
        .when((found_a > 0) | (found_b > 0), "overlap")
        .otherwise("none")
    )

"""Alignments against Python, pair by pair."""

import random
from collections import Counter

from pyspark.sql import functions as F

from shelfspark.operators import alignment


def brute(a, b, least, most, first_least=1, offsets=3):
    free_a, free_b, out = set(range(len(a))), set(range(len(b))), []
    for n in range(most):
        votes = Counter(i - j for i in free_a for j in free_b if a[i] == b[j])
        best = None
        for shift in sorted(votes, key=lambda s: (-votes[s], s))[:offsets]:
            runs, now = [], []
            for i in range(len(a)):
                ok = i in free_a and i - shift in free_b and bin((a[i] ^ b[i - shift]) & 0xFFFFFFFF).count("1") < 10
                if ok:
                    now.append(i)
                if (not ok or i + 1 == len(a)) and now:
                    runs.append(now)
                    now = []
            runs = [r for r in runs if len(r) >= (least if n else first_least)]
            bits = sum(bin((a[i] ^ b[i - shift]) & 0xFFFFFFFF).count("1") for r in runs for i in r)
            size = sum(map(len, runs))
            if runs and (best is None or (-size, bits, shift) < best[0]):
                best = ((-size, bits, shift), runs, shift)
        if best is None:
            break
        for r in best[1]:
            out.append((n, r[0], r[0] - best[2], len(r), sum(bin((a[i] ^ b[i - best[2]]) & 0xFFFFFFFF).count("1") for i in r)))
            free_a -= set(r)
            free_b -= {i - best[2] for i in r}
    return sorted(out)


def test_same_as_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.getrandbits(32)
    song = [word() for _ in range(200)]
    noisy = [x ^ (1 << rng.randrange(32)) if rng.random() < 0.3 else x for x in song]
    seqs = {1: song, 2: noisy[30:], 3: song[:60] + song[120:], 4: [word() for _ in range(50)], 5: song[100:150] + [word() for _ in range(20)] + song[:50], 6: [7] * 12}
    pairs = [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (6, 6), (1, 9)]
    rows = spark.createDataFrame([(k, v) for k, v in seqs.items()], "id long, v array<long>")
    seq = alignment.items(rows, "id", F.col("v"))
    p = spark.createDataFrame(pairs, "a long, b long")
    found = alignment.align(p, seq, least=10, most=4)
    got = {}
    for r in found.collect():
        got.setdefault((r.a, r.b), []).append((r.alignment, r.start_a, r.start_b, r.items, r.bits))
    for a, b in pairs:
        assert sorted(got.get((a, b), [])) == (brute(seqs[a], seqs[b], 10, 4) if b in seqs else []), (a, b)
    sums = {(r.a, r.b): r for r in alignment.compared(p, seq, found).collect()}
    assert sums[1, 4].score == 32.0 and sums[1, 3].found_b == 1.0 and 0.6 < sums[1, 3].found_a < 0.75 and sums[1, 9].coverage_b == 0.0
    case = alignment.audio_case(*(F.col(c) for c in ("found_a", "found_b", "coverage_a", "coverage_b", "score")))
    cases = {(r.a, r.b): r.c for r in alignment.compared(p, seq, found).withColumn("c", case).collect()}
    assert cases[6, 6] == "same" and cases[1, 4] == "none" and cases[1, 3] == "b_within_a"


def test_empty(spark):
    seq = spark.createDataFrame([], "id long, pos int, item long")
    assert alignment.align(spark.createDataFrame([(1, 2)], "a long, b long"), seq).count() == 0


def test_items_are_not_broadcast(spark):
    """taken places, spread out from a small file, are merged with the items and not sent to every task by the driver."""
    seq = spark.range(1000).select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.col("id").cast("int").alias("pos"), F.col("id").alias("item"))
    seq = alignment.stored(seq, "items")
    taken = alignment.stored(spark.createDataFrame([(1, 2, 5, 5, 900)], "a int, b int, start_a int, start_b int, items long"), "taken")
    free = alignment._free(seq, taken, "a")
    shifts = alignment._votes(seq, seq, 1)
    for df, rows in ((free, 100), (shifts, 1), (alignment._stretches(seq, seq, shifts, 1), 1)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == rows


def test_long_and_short_sequences_alike(spark, monkeypatch):
    """pairs with a sequence too long for a task are joined item by item, with the same stretches; so are places with gaps."""
    rng = random.Random(6)
    words = [rng.getrandbits(32) for _ in range(40)]
    song = [rng.choice(words) for _ in range(150)]
    seqs = {1: song, 2: song[40:] + song[:30], 3: [*song[:50], None, *song[51:90]], 4: [], 5: [words[0]] * 30, 6: [words[0], None] * 15, 7: None}
    rows = spark.createDataFrame(list(seqs.items()), "id long, items array<long>")
    pairs = spark.createDataFrame([(a, b) for a in seqs for b in [*seqs, 9]] + [(1, 2)], "a long, b long")
    seq = alignment.items(rows, "id", F.col("items")).withColumn("pos", F.col("pos") * 3)
    whole = lambda df: sorted(map(tuple, df.collect()))
    lists = lambda: whole(alignment.align_lists(pairs, rows, least=5, most=3))
    gaps = lambda: whole(alignment.align(pairs, seq, least=1, most=3))
    known, rows_only = lists(), whole(alignment._by_rows(pairs.distinct(), alignment.items(rows, "id", F.col("items")).where("item IS NOT NULL"), 5, 3, 1, 3))
    apart = gaps()
    assert known == rows_only and len(known) > 20 and len(apart) > 200 and all(r[5] == 1 for r in apart)
    monkeypatch.setattr(alignment, "MEETINGS", 7)
    assert lists() == known
    for held in (100, 20, 0):
        monkeypatch.setattr(alignment, "HELD", held)
        assert lists() == known and (held != 100 or gaps() == apart)


def test_items_are_shuffled_for_two_joins(spark):
    """the rounds of a pair write no items to disk."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    rng = random.Random(7)
    song = [rng.getrandbits(32) for _ in range(500)]
    rows = spark.createDataFrame([(k, song[k:] + song[:k]) for k in range(20)], "id long, items array<long>").coalesce(1)
    seq = alignment.items(rows, "id", F.col("items"))
    began = shuffled()
    found = alignment.align(spark.range(1, 20).selectExpr("0L AS a", "id AS b"), seq, least=10, most=3)
    assert found.where("alignment < 2").count() == 29  # what 1 to 9 items leave is no stretch of its own
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < shuffled() - began < 3 * 20 * 500

import math
import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from shelfspark.llm import centroids
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k, rounds, seed=3, dims=2):
    """Everything in Python's whole numbers."""
    exact = lambda x: math.floor(x * 1024) if abs(x) < 2**40 else int(x) * 1024
    kept = [(i, [exact(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]
    d = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    near = lambda v: min(range(len(c)), key=lambda j: (d(v, c[j]), j))
    for _ in range(rounds if c else 0):
        of = [near(v) for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, near(v), d(v, c[near(v)])) for i, v in kept]
    fits = lambda x: x if x < 2**63 else None
    sums = {j: sum(z for _, x, z in out if x == j) for j in {x for _, x, _ in out}}
    whole = {j: fits(s) if all(z < 2**63 for _, x, z in out if x == j) else None for j, s in sums.items()}
    total = fits(sum(sums.values())) if None not in whole.values() else None
    return sorted(((i, j, fits(z), whole[j], total, sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, z in out), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    return sorted(map(tuple, centroids.clusters(df, dims=2, **how).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    rng = random.Random(seed)
    grid = [(i, [rng.randrange(-3, 4) / 4, rng.randrange(-3, 4) / 4]) for i in range(120)]  # many ties and repeated vectors
    assert run(spark, grid, k=5, rounds=4) == brute(grid, 5, 4)


def test_odd_rows(spark):
    odd = [(None, [0.5, 0.25]), (None, [0.5, 0.25]), (7, [1.0, -1.0]), (7, [2.0, -1.0]), (8, None), (9, [1.0]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (12, [None, 1.0]), (13, [-0.0004, 1e-300])]
    assert run(spark, odd, k=8, rounds=2) == brute(odd, 8, 2)
    assert run(spark, [], k=8, rounds=2) == [] and run(spark, [(1, None)], k=2, rounds=1) == []


def test_components_of_any_size(spark):
    big = [(1, [1e30, 0.0]), (2, [1e30, 3.0]), (3, [-2.0**60, 1.0]), (4, [0.5, 0.5]), (5, [2.0**20, -(2.0**20)]), (6, [2.0**16, 0.1])]
    got = run(spark, big, k=3, rounds=3)
    assert got == brute(big, 3, 3) and any(r[4] is None for r in got) is (brute(big, 3, 3)[0][4] is None)


def test_interval_holds_what_is_nearest():
    """The screening never loses the nearest centroid, with numbers at the edge of what float32 holds."""
    rng = np.random.default_rng(0)
    v = rng.integers(-(1 << 23), 1 << 23, (300, 64))
    c = np.concatenate([v[:5] + rng.integers(-1, 2, (5, 64)), v[:5]])
    exact = ((v[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(2)
    may = centroids.contenders(v, c)
    assert all(may[i, int(np.argmin(exact[i]))] for i in range(len(v))) and may.sum() < may.size
    number, distance = centroids.nearest(v, c)
    assert number.tolist() == [min(range(10), key=lambda j: (exact[i, j], j)) for i in range(300)] and distance.tolist() == [min(r) for r in exact.tolist()]


def test_whole_table_and_other_columns(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("label", "distance")
    df = centroids.op11(vectors)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(centroids.OP11_SQL).fetchall())
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

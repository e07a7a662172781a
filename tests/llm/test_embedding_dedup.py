import math

import numpy as np

from shelfspark.llm import embedding_dedup as e


def brute(rows, least=0.9):
    ok = [v is not None and None not in v and len(v) > 0 and all(map(math.isfinite, v)) and any(v) for _, v in rows]
    unit = [np.array(v, float) / max(map(abs, v)) if o else None for (_, v), o in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and (rows[i][1] == rows[j][1] or unit[i] @ unit[j] >= least):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            low[find(i)] = min(low.get(find(i), name), name)
    return sorted(((name is None, name or 0, links[i], low.get(find(i))) for i, (name, _) in enumerate(rows)), key=repr)


def run(spark, rows, kind="double", **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, node int, vec string").repartition(3)
    return sorted(((r.id is None, r.id or 0, r.n_links, r.component) for r in e.near_duplicates(df, **more).collect()), key=repr)


def data(dim, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(60, dim))
    near = [b + r.normal(size=dim) * s for b in base[:20] for s in (0.1, 0.3, 0.45, 0.5, 0.6)]
    dense = [base[0] + r.normal(size=dim) * 0.05 for _ in range(80)]
    v = [*base, *near, *dense, *[base[1]] * 30, base[2] * 7]
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


def test_against_brute_force(spark):
    for dim, seed in ((64, 1), (6, 2), (1, 3)):
        rows = data(dim, seed)
        assert run(spark, rows) == brute(rows)


def test_small_chunks(spark):
    """Many cells, visitors and chunks of hot cells."""
    rows = data(16, 5)
    assert run(spark, rows, chunk=16) == brute(rows)
    assert run(spark, rows, chunk=5, blocks=3) == brute(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, None), (3, [0.0] * 3), (4, [1.0, None, 2.0]), (5, [float("nan")] * 3), (6, [float("inf"), 0.0, 0.0]), (7, [2.0, 4.0, 6.0])]
    rows += [(None, v), (8, []), (9, [1.0, 2.0]), (10, [1e300, 2e300, 3e300]), (1, [-1.0, 0.0, 0.5]), (11, [-0.0, 0.0, 0.0]), (12, [-v for v in v])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(2, None), (3, [0.0])]) == brute([(2, None), (3, [0.0])])
    assert e.op9(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert sorted(((False, r.vec_id, r.n_links, r.component_id) for r in e.op9(df).collect()), key=repr) == want

import numpy as np

from shelfspark.operators import similar


def balanced(x, y):
    """Weights and bias of the reference's loss by Newton steps."""
    n, inside = len(y), y.sum()
    s = np.where(y == 1, n / (2 * inside), n / (2 * (n - inside)))
    a, b = np.c_[x, np.ones(n)], np.zeros(x.shape[1] + 1)
    ridge = np.diag([10 / n] * x.shape[1] + [0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-a @ b))
        b -= np.linalg.solve((a * (s * p * (1 - p))[:, None]).T @ a / n + ridge, a.T @ (s * (p - y)) / n + ridge @ b)
    return b


def test_rare_label_is_guessed(spark):
    r = np.random.default_rng(3)
    middle = {"a": (0, 0), "b": (3, 0), "rare": (1.2, 2)}
    sizes = {"a": 600, "b": 300, "rare": 12, "few": 9}
    rows = [(k, [float(v) for v in r.normal(middle.get(k, (0, 0)), 1)]) for k, n in sizes.items() for _ in range(n)]
    rows = [(i, *x) for i, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    got = {x.vec_id: {g.label: g.share for g in x.guesses} for x in similar.guesses(similar.genre_model(df), df).collect()}
    kept = [x for x in rows if x[1] != "few"]
    x = np.array([v for *_, v in kept], np.float32).astype(float)
    every = np.array([v for *_, v in rows], np.float32).astype(float)
    mean, std = x.mean(0), x.std(0, ddof=1)
    shares = {}
    for k in ("a", "b", "rare"):
        b = balanced((x - mean) / std, np.array([float(own == k) for _, own, _ in kept]))
        shares[k] = 1 / (1 + np.exp(-(((every - mean) / std) @ b[:-1] + b[-1])))
    for i, _, _ in rows:
        for k, p in shares.items():
            share = got[i].get(k)
            assert share is None and p[i] < 0.301 or abs(share - p[i]) < 1e-3
    assert sum("rare" in got[i] for i, k, _ in rows if k == "rare") >= 9


def test_no_limit_of_labels(spark):
    df = spark.createDataFrame([(f"g{k % 1200:04}",) for k in range(2400)] + [(None,)] * 5, "label string")
    assert similar.learnable(df, least=2) == {f"g{k:04}": 2 for k in range(1200)}

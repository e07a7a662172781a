"""Similarity of vectors, percentile scores and a genre model."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.storage import stored


def mean_vector(vectors: DataFrame, column: str) -> list[float]:
    """Mean of each dimension: one aggregation, one row of the vectors' length."""
    cells = vectors.select(F.posexplode(column).alias("i", "x"))
    return [r[0] for r in cells.groupBy("i").agg(F.avg(F.col("x").cast("double"))).orderBy("i").select("avg(CAST(x AS DOUBLE))").collect()]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sounds_like(vectors: DataFrame, target: int, most: int = 25, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The vectors most like one of them: cosine after taking the mean vector off; order cosine, then id."""
    mean = F.array(*map(F.lit, mean_vector(vectors, column)))
    centred = vectors.select(F.col(id_col).alias("id"), F.zip_with(F.transform(column, lambda x: x.cast("double")), mean, lambda x, m: x - m).alias("v"))
    rows = centred.withColumn("norm", F.sqrt(_dot(F.col("v"), F.col("v"))))
    one = rows.where(F.col("id") == target).limit(1).select(F.col("v").alias("tv"), F.col("norm").alias("tn"))
    cosine = F.when((F.col("norm") > 1e-9) & (F.col("tn") > 1e-9), _dot(F.col("v"), F.col("tv")) / (F.col("norm") * F.col("tn"))).otherwise(0.0)
    found = rows.where(F.col("id") != target).join(F.broadcast(one)).select("id", cosine.alias("cosine"))
    top = found.orderBy(F.desc("cosine"), "id").limit(most)
    percent = F.round(100 * F.least(F.greatest("cosine", F.lit(0.0)), F.lit(1.0))).cast("int")
    return top.select(F.col("id").alias(id_col), F.round("cosine", 6).alias("cosine"), percent.alias("percent"))


def _places(rows: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """(value, n__, low__, total__) of the different known values: how many rows have it, how many have less, and all.

    Values are counted first and put in order in ranges: a running sum within each
    range, and the ranges' totals before it. The ranges are written, since a range's
    number must be the same wherever it is read.
    """
    n_parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n__"))
    ranged = stored(counts.repartitionByRange(n_parts, value).withColumn("part__", F.spark_partition_id()), "ranges")
    before = F.sum("n__").over(Window.partitionBy("part__").orderBy(value)) - F.col("n__")
    totals = ranged.groupBy("part__").agg(F.sum("n__").alias("all__"))  # a row for each range
    totals = totals.withColumn("base__", F.coalesce(F.sum("all__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = totals.withColumn("total__", F.sum("all__").over(Window.partitionBy()))
    placed = ranged.withColumn("low__", before).join(F.broadcast(totals), "part__")
    return placed.select(value, "n__", (F.col("low__") + F.col("base__")).alias("low__"), "total__")


def mid_ranks(rows: DataFrame, value: str, out: str, parts: int | None = None) -> DataFrame:
    """Adds the mid-rank (share below, ties half) of each row's value among the known ones; null stays null."""
    low = F.col("low__")
    ranks = _places(rows, value, parts).select(value, ((low + low + F.col("n__")) / 2 / F.col("total__")).alias(out))
    return rows.join(ranks, value, "left")


def decile(rank: Column) -> Column:
    return F.least(F.greatest(F.floor(rank * 10) + 1, F.lit(1)), F.lit(10)).cast("int")


def energy_score(rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``score`` (mean of the features' mid-ranks that are known) and ``level``, its decile among all."""
    for f in features:
        rows = mid_ranks(rows, f, f"r_{f}")
    known = F.array_compact(F.array(*(f"r_{f}" for f in features)))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    rows = mid_ranks(rows.withColumn("score", mean), "score", "rank__")
    return rows.withColumn("level", decile(F.col("rank__"))).drop("rank__", *(f"r_{f}" for f in features))


def cut_points(rows: DataFrame, value: str, n: int = 101) -> DataFrame:
    """(k, cut): interpolated percentiles of a column; an empty one has none.

    Each different value knows which of the n places between the least and the
    greatest fall on its rows, so only the values at those places go on.
    """
    last, step = F.lit(n - 1).cast("long"), F.col("total__") - 1
    low, high = F.col("low__"), F.col("low__") + F.col("n__")
    up = lambda x: F.ceil(x * last / step)
    down = lambda x: F.floor(x * last / step)
    within = lambda a, z: F.filter(F.sequence(F.greatest(a, F.lit(0)), F.least(z, last) + 1), lambda k: k <= F.least(z, last))
    every = F.sequence(F.lit(0).cast("long"), last)
    some = lambda a, z: F.when(step == 0, every).when(F.greatest(a, F.lit(0)) <= F.least(z, last), within(a, z)).otherwise(F.array().cast("array<bigint>"))
    ends = F.concat(
        F.transform(some(up(low), up(high) - 1), lambda k: F.struct(k.alias("k"), F.lit(False).alias("upper"))),
        F.transform(some(down(low - 1) + 1, down(high - 1)), lambda k: F.struct(k.alias("k"), F.lit(True).alias("upper"))),
    )
    found = _places(rows, value).select(value, (F.col("total__") - 1).alias("step"), F.explode(ends).alias("e"))
    both = found.groupBy("e.k", "step").agg(F.min(F.when(~F.col("e.upper"), F.col(value))).alias("a"), F.min(F.when(F.col("e.upper"), F.col(value))).alias("b"))
    place = F.col("k") * F.col("step") / last
    return both.select(F.col("k").cast("int").alias("k"), (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("cut"))


def learnable(rows: DataFrame, label: str = "label", least: int = 10) -> dict:
    """The labels of at least ``least`` rows, in order, each with its number of rows."""
    sizes = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return {r[0]: r["n"] for r in sizes.orderBy(label).collect()}


def genre_model(rows: DataFrame, label: str = "label", column: str = "embedding", least: int = 10):
    """One-vs-rest logistic model of the labels with enough rows, on standardised vectors; null if fewer than two.

    Each label is fitted with balanced weights: its rows together count as much as all the others.
    """
    sizes = learnable(rows, label, least)
    if len(sizes) < 2:
        return None
    n, kind = sum(sizes.values()), rows.schema[label].dataType
    known = rows.sparkSession.createDataFrame([(v,) for v in sizes], T.StructType([T.StructField(label, kind)]))
    train = rows.join(F.broadcast(known), label).select(array_to_vector(column).alias("raw"), F.col(label).alias("own"))
    seen = train.select(Summarizer.metrics("mean", "variance").summary(F.col("raw")).alias("s")).first().s
    mean, spread = seen.mean.toArray(), np.sqrt(seen.variance.toArray() * (n - 1) / n)  # of the population
    level = lambda v: F.transform(F.arrays_zip(v.alias("v"), F.lit(mean.tolist()).alias("m"), F.lit(spread.tolist()).alias("s")), lambda z: F.when(z["s"] > 1e-6, (z["v"] - z["m"]) / z["s"]).otherwise(0.0))
    train = train.select(array_to_vector(level(vector_to_array("raw"))).alias("x"), "own").persist()
    method = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=10.0 / n, maxIter=300, standardization=False)
    models = []
    for v, inside in sizes.items():
        own = F.col("own") == F.lit(v)
        weight = F.when(own, n / (2.0 * inside)).otherwise(n / (2.0 * (n - inside)))
        models.append(method.fit(train.select("x", own.cast("double").alias("y"), weight.alias("w"))))
    train.unpersist()
    return list(sizes), kind, (mean, spread), models


def guesses(model, rows: DataFrame, column: str = "embedding", most: int = 3, least: float = 0.30) -> DataFrame:
    """Adds ``guesses``: the labels whose sigmoid is at least ``least``, best first."""
    labels, kind, (mean, spread), models = model
    weights = np.array([m.coefficients.toArray() for m in models])
    scale = np.where(spread > 1e-6, spread, np.inf)
    w = weights / scale
    bias = np.array([m.intercept for m in models]) - w @ mean
    fields = T.StructType().add("label", kind).add("bias", T.DoubleType()).add("w", T.ArrayType(T.DoubleType()))
    table = [(v, float(bias[i]), w[i].tolist()) for i, v in enumerate(labels)]  # one row, however many labels
    one = rows.sparkSession.createDataFrame([(table,)], T.StructType().add("models__", T.ArrayType(fields)))
    score = lambda m: -1 / (1 + F.exp(-(_dot(F.col(column).cast("array<double>"), m["w"]) + m["bias"])))
    scores = F.transform("models__", lambda m: F.struct(score(m).alias("s"), m["label"].alias("label")))
    rows = rows.crossJoin(F.broadcast(one))
    best = F.filter(F.slice(F.array_sort(scores), 1, most), lambda g: g["s"] <= -least)
    return rows.withColumn("guesses", F.transform(best, lambda g: F.struct(g["label"].alias("label"), (-g["s"]).alias("share")))).drop("models__")

"""Clustering of integer vectors by nearest centroid, exact to the last bit.

Each round is one pass over the vectors. A task multiplies its vectors with all
centroids in float32 and puts around each product an interval that is sure to hold
the true value. A vector whose least interval overlaps no other is decided; for the
others the overlapping centroids' distances are computed with whole numbers, and of
equal ones the lowest number wins. Tasks send sums for each centroid and component,
never vectors, so one hot cluster is as cheap as many.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.storage import stored

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Whole numbers below this are exact in float32.
SINGLE = 1 << 24
#: Sums of squares of differences of numbers below this fit into 64 bits, up to 128 components.
DOUBLE = 1 << 27
#: Sums travel in parts of so many bits, each in a long.
LIMB = 40
#: Vectors multiplied at once.
ROWS = 4096


def grid(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles, for a scale that is a power of two; Python's whole numbers if one is too large for 64-bit distances."""
    if not len(values) or np.abs(values).max() < DOUBLE / scale:
        return np.floor(values * scale).astype(np.int64)
    whole = lambda x: int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale)
    return np.array([[whole(x) for x in row] for row in values.tolist()], object)


def contenders(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to which vector: intervals of \\|c\\|^2 - 2 v.c that overlap the least one.

    A float32 product of d terms, summed in any order, errs by at most
    g |v| |c| with g = d u / (1 - d u) and u = 2 ** -24; what is done in double
    precision around it errs by less than 2 ** -50 of its terms.
    """
    if object in (v.dtype, c.dtype) or max(np.abs(v).max(), np.abs(c).max()) >= SINGLE:
        return np.ones((len(v), len(c)), bool)
    d = v.shape[1]
    g = d * 2.0**-24 / (1 - d * 2.0**-24)
    square = (c * c).sum(1).astype(np.float64)
    norm = lambda x: np.sqrt((x * x).sum(1).astype(np.float64)) * (1 + 2.0**-48)
    twice = 2.0 * (v.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    middle = square - twice
    error = 2 * g * np.outer(norm(v), norm(c)) + 2.0**-50 * (square + np.abs(twice) + 1)
    return middle - error <= (middle + error).min(1)[:, None]


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, the lowest number of equals."""
    number, distance = np.zeros(len(v), np.int64), []
    exact = object in (v.dtype, c.dtype) or max(np.abs(c).max(), np.abs(v).max(initial=0)) >= DOUBLE
    v, c = (v.astype(object), c.astype(object)) if exact else (v, c)
    for at in range(0, len(v), ROWS):
        part = v[at : at + ROWS]
        may = contenders(part, c)
        number[at : at + ROWS] = may.argmax(1)
        open_rows = np.flatnonzero(may.sum(1) > 1)
        row, centroid = np.nonzero(may[open_rows])
        squares = np.concatenate([((part[open_rows[row[k : k + ROWS]]] - c[centroid[k : k + ROWS]]) ** 2).sum(1) for k in range(0, len(row), ROWS)] or [np.zeros(0, np.int64)])
        order = np.lexsort((centroid, squares, row)) if squares.dtype != object else np.array(sorted(range(len(row)), key=lambda k: (row[k], squares[k], centroid[k])), np.int64)
        first = order[np.unique(row[order], return_index=True)[1]]
        number[at + open_rows] = centroid[first]
        distance.append(((part - c[number[at : at + ROWS]]) ** 2).sum(1))
    return number, np.concatenate(distance) if distance else np.zeros(0, np.int64)


def _matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    return grid(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims), scale)


def _array(centroids: list[list[int]]) -> np.ndarray:
    big = max((abs(x) for c in centroids for x in c), default=0) >= DOUBLE
    return np.array(centroids, object if big else np.int64)


def kept(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of exactly ``dims`` components, none null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return rows.where((F.size("v") == dims) & F.forall("v", finite))


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors whose ``seed:id`` has the smallest SHA-256; a null id is empty, equal ids go by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return [grid(np.array([r.v], np.float64), scale)[0].tolist() for r in chosen]


def _sums(rows: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int] | None]:
    """One round: the centroids' next places; a cluster without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _array(centroids)
        total, n = np.zeros(c.shape, object), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(0), dims, scale)
                number, _ = nearest(v, c)
                n += np.bincount(number, minlength=len(c))
                for j in np.unique(number):
                    total[j] += v[number == j].sum(0)
        parts = [(j, -1, 0, int(n[j])) for j in range(len(c)) if n[j]]
        for j, i in ((j, i) for j in range(len(c)) if n[j] for i in range(dims)):
            s, limb = int(total[j, i]), 0
            while abs(s) >= 1 << LIMB:
                s, low = divmod(s, 1 << LIMB)
                parts.append((j, i, limb, low))
                limb += 1
            parts.append((j, i, limb, s))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts) if parts else [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "limb", "part"])

    parts = rows.select("v").mapInArrow(run, "cluster int, dim int, limb int, part long")
    total = [[0] * dims for _ in centroids]
    n = [0] * len(centroids)
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum("part").alias("part")).collect():  # some numbers for each centroid and component
        if r.dim < 0:
            n[r.cluster] = r.part
        else:
            total[r.cluster][r.dim] += r.part << LIMB * r.limb
    return [[s // n[j] for s in total[j]] if n[j] else c for j, c in enumerate(centroids)]


def clusters(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that counts.

    Vectors of another length, null ones, and those with a null or not finite component
    are left out. Fewer vectors than k make fewer centroids; an empty table gives an empty
    result. Ids may be null or repeat; each row counts by itself. Components of any size are
    exact; a distance or inertia that 64 bits do not hold is null. Other columns are ignored.
    """
    spark: SparkSession = vectors.sparkSession
    rows = stored(kept(vectors, dims, id_col, vector_col), "cluster-vectors")
    centroids = first_centroids(rows, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = _sums(rows, centroids, dims, scale)

    fits = lambda x: int(x) if x < 1 << 63 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _array(centroids)
        for b in batches:
            if b.num_rows:
                number, distance = nearest(_matrix(b.column(1), dims, scale), c)
                listed = pa.array([fits(x) for x in distance], pa.int64()) if distance.dtype == object else pa.array(distance, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int32()), listed], ["id", "cluster", "distance"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    found = stored(rows.mapInArrow(run, schema), "cluster-rows")
    whole = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(whole.alias("s")).collect()}  # a row for each centroid
    total = fits(int(sum(inertia.values()))) if None not in inertia.values() else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(j, None if s is None else fits(int(s)), total, digest(centroids[j])) for j, s in inertia.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(vectors: DataFrame) -> DataFrame:
    return clusters(vectors).withColumnRenamed("id", "vec_id")


def _sql(rounds: int = ROUNDS) -> str:
    """Every distance of every round, in whole numbers."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {CENTROIDS})
)"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (
  SELECT vec_id, v, j, d FROM (
    SELECT vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{n}
  ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1
)"""
        )
        if n < rounds:
            steps.append(
                f"""s{n} AS (
  SELECT j, i, sum(x) AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY j, i
), c{n + 1} AS MATERIALIZED (
  SELECT c{n}.j, coalesce(m.c, c{n}.c) AS c FROM c{n}
  LEFT JOIN (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{n} GROUP BY j) m ON m.j = c{n}.j
)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (j)"""


OP11_SQL = _sql()

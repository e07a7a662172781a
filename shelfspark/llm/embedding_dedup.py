"""Embedding near-duplicates by an exact subspace pigeonhole join.

Unit vectors with cosine >= c are at a squared distance <= 2 - 2c. They are
rotated to their principal axes and split into blocks of few dimensions; each
block gets a part of the squared distance in proportion to its variance. Two
vectors within the distance are within the budget of at least one block, so a
range join of each block finds all pairs, and the cosine in double precision
decides. Rotated coordinates are rounded to integers (with the rounding added to
the budgets), so block distances are exact and a pair that several blocks find
counts in the first of them only.

A block's range join works on a grid of quantiles over its leading axes: a vector
lives in one cell and looks into the cells before it that lie within its budget.
A cell with many vectors is cut into chunks that meet pairwise, each pair of
chunks as a group of its own. Pairs are not put out: a group returns the number of links of each
vector and a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.graph import connected_components
from shelfspark.storage import stored

LEAST_COSINE = 0.9
BLOCKS = 4
#: Axes of a block's grid.
GRID_AXES = 3
#: Vectors in a chunk, and about as many in a cell.
CHUNK = 16384
#: Rotated unit coordinates are rounded to multiples of 1 / SCALE.
SCALE = 1 << 20
TILE = 1024


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, node, vec): node is a 128-bit hash and vec the bytes of a usable vector as doubles; null for others."""
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("dim", T.IntegerType()), T.StructField("node", T.BinaryType()), T.StructField("vec", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, nodes, data = [], [], []
            for x in b.column(1):
                values = x.as_py()
                ok = values is not None and None not in values
                v = np.asarray(values if ok else [], "<f8") + 0.0  # no negative zeros
                with np.errstate(over="ignore", invalid="ignore"):
                    usable = len(v) > 0 and np.isfinite(v).all() and v.any()
                dims.append(len(v) if usable else None)
                data.append(v.tobytes() if usable else None)
                nodes.append(xxhash.xxh3_128_digest(data[-1]) if usable else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(nodes, pa.binary()), pa.array(data, pa.binary())], names=["id", "dim", "node", "vec"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).mapInArrow(run, schema)


def units(data: list[bytes]) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow of large components."""
    m = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _moments(nodes: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """(number, second moments) of the unit vectors, added up in the tasks and by grouping: dim * dim sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for b in batches:
            if b.num_rows:
                u = units(b.column(0).to_pylist())
                total += u.T @ u
                n += len(u)
        flat = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "x"])

    flat = np.zeros(dim * dim + 1)
    for r in nodes.select("vec").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        flat[r["k"]] = r["x"]
    return int(flat[-1]), flat[:-1].reshape(dim, dim)


class Plan:
    """Rotation, blocks, budgets and grids; what is sent to the tasks is bounded by the dimension and the number of cells."""

    def __init__(self, n: int, moments: np.ndarray, cosine: float, blocks: int):
        dim = len(moments)
        value, axes = np.linalg.eigh(moments / max(n, 1))
        blocks = min(blocks, dim)
        # axes are dealt to blocks so that each gets large and small ones
        deal = [np.arange(dim)[::-1][b::blocks] for b in range(blocks)]
        self.rotation = axes[:, np.concatenate(deal)]
        self.cuts = np.cumsum([0, *map(len, deal)])
        share = np.array([np.clip(value[d], 0, None).sum() + 1e-9 for d in deal])
        limit = 2 - 2 * cosine
        # each rounded coordinate is off by half a unit, so a block's distance by sqrt(width) units at most
        part = np.sqrt(limit * share / share.sum() * (1 + 1e-9)) * SCALE
        self.budget = np.ceil((part + np.sqrt(np.diff(self.cuts))) ** 2)
        self.cosine = cosine
        self.edges: list[list[np.ndarray]] = []

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        """Integers as doubles: sums of their products are exact."""
        return np.rint(unit @ self.rotation * SCALE)

    def grid_axes(self) -> list[list[int]]:
        return [list(range(a, min(a + GRID_AXES, b))) for a, b in zip(self.cuts, self.cuts[1:])]

    def cells(self, q: np.ndarray, block: int) -> np.ndarray:
        cell = np.zeros(len(q), np.int64)
        for axis, edges in zip(self.grid_axes()[block], self.edges[block]):
            cell = cell * (len(edges) + 1) + np.searchsorted(edges, q[:, axis], "right")
        return cell

    def looks(self, q: np.ndarray, block: int) -> np.ndarray:
        """rows x cells: whether a cell lies within the budget of a row."""
        far = np.zeros((len(q), 1))
        for axis, edges in zip(self.grid_axes()[block], self.edges[block]):
            x = q[:, axis, None]
            low, high = np.append(-np.inf, edges), np.append(edges, np.inf)
            gap = np.maximum(np.maximum(low - x, x - high), 0) ** 2
            far = (far[:, :, None] + gap[:, None, :]).reshape(len(q), -1)
        return far <= self.budget[block]


def _cell_rows(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(block, cell, home, salt, node): where each vector lives and looks; salt is a uniform 31-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(0).to_pylist()
            q = plan.rotated(units(b.column(1).to_pylist()))
            salt = np.array([int.from_bytes(x[:4], "little") >> 1 for x in names], np.int32)
            for block in range(len(plan.budget)):
                own = plan.cells(q, block)
                count = int(np.prod([len(e) + 1 for e in plan.edges[block]]))
                step = max(1, (1 << 22) // count)
                for at in range(0, len(q), step):
                    near = plan.looks(q[at : at + step], block) & (np.arange(count) < own[at : at + step, None])
                    i, cell = np.nonzero(near)
                    home = np.arange(len(near))
                    i = np.concatenate((home, i)) + at
                    cell = np.concatenate((own[at : at + step], cell))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), block, np.int32)), pa.array(cell), pa.array(np.arange(len(i)) < len(home)), pa.array(salt[i]), b.column(0).take(pa.array(i))],
                        names=["block", "cell", "home", "salt", "node"],
                    )

    return nodes.select("node", "vec").mapInArrow(run, "block int, cell long, home boolean, salt int, node binary")


def _forest(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> list[int]:
    """Positions of the edges (a, b) that join two trees of ``parent``, which is updated."""
    keep = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep.append(k)
    return keep


def links_between(plan: Plan, block: int, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the linked pairs of two sets of unit vectors that ``block`` is the first to find, a tile at a time; same: only i < j."""
    ql, qr = plan.rotated(left), plan.rotated(right)
    cut = [slice(a, b) for a, b in zip(plan.cuts, plan.cuts[1:])]

    def extended(q: np.ndarray, k: int, side: int) -> np.ndarray:
        x = q[:, cut[k]]
        norm, one = (x * x).sum(1, keepdims=True), np.ones((len(x), 1))
        return np.hstack([2 * x, -norm + plan.budget[k], -one] if side == 0 else [x, one, norm])

    el, er = extended(ql, block, 0), extended(qr, block, 1)
    for a in range(0, len(left), TILE):
        for b in range(a if same else 0, len(right), TILE):
            i, j = np.nonzero(el[a : a + TILE] @ er[b : b + TILE].T >= 0)  # within this block's budget
            if same and a == b:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 17):
                x, y = i[at : at + (1 << 17)] + a, j[at : at + (1 << 17)] + b
                linked = np.einsum("ij,ij->i", left[x], right[y]) >= plan.cosine
                x, y = x[linked], y[linked]
                for k in range(block):  # an earlier block has found it
                    d = ql[x, cut[k]] - qr[y, cut[k]]
                    first = (d * d).sum(1) > plan.budget[k]
                    x, y = x[first], y[first]
                if len(x):
                    yield x, y


def _join(nodes: DataFrame, plan: Plan, chunk: int) -> DataFrame:
    """(node, links, other): a row per vector and group with the number of rows linked to it; other is set in forest edges."""
    spots = stored(_cell_rows(nodes, plan), "embedding-cells")
    sizes = spots.groupBy("block", "cell").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.when(~F.col("home"), 1)).alias("visits"))
    sizes = sizes.where("homes > 0 and homes + visits > 1")  # nobody lives there, or nobody meets
    parts = lambda c: F.ceil(F.greatest(F.col(c), F.lit(1)) / chunk).cast("int")
    spots = spots.join(sizes.select("block", "cell", parts("homes").alias("h"), parts("visits").alias("v")), ["block", "cell"])
    own = F.when(F.col("home"), F.pmod("salt", F.col("h"))).otherwise(F.pmod("salt", F.col("v")))
    spots = spots.withColumn("own", own)
    # homes s and t meet in group (s, t), s <= t; visitors u meet homes s in group (s, -1 - u)
    other_homes = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda t: F.struct(F.least("own", t).alias("s"), F.greatest("own", t).alias("t"), (F.col("own") > t).cast("int").alias("side")))
    visitors = F.transform(F.sequence(F.lit(0), F.col("v") - 1), lambda u: F.struct(F.col("own").alias("s"), (-1 - u).alias("t"), F.lit(0).alias("side")))
    meets = F.when(F.col("home"), F.concat(other_homes, visitors)).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda s: F.struct(s.alias("s"), (-1 - F.col("own")).alias("t"), F.lit(1).alias("side")))
    )
    groups = spots.select("block", "cell", "node", F.explode(meets).alias("m")).select("block", "cell", "node", "m.*")
    rows = groups.join(nodes.select("node", "vec", "weight"), "node")
    out = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])

    def meet(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        block, same = group["block"][0].as_py(), group["s"][0].as_py() == group["t"][0].as_py()
        order = np.argsort(side, kind="stable")
        n_left = len(side) if same else int((side == 0).sum())
        if not same and n_left in (0, len(side)):
            return out.empty_table()
        names = group["node"].take(pa.array(order))
        weight = group["weight"].to_numpy()[order]
        unit = units(group["vec"].take(pa.array(order)).to_pylist())
        left, right, shift = (unit, unit, 0) if same else (unit[:n_left], unit[n_left:], n_left)
        links, parent, edges = np.zeros(len(unit), np.int64), np.arange(len(unit)), []
        for i, j in links_between(plan, block, left, right, same):
            j = j + shift
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            k = _forest(i, j, parent)
            edges.append((i[k], j[k]))
        a, b = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.intp),) * 2
        found = np.flatnonzero(links)
        src = pa.concat_arrays([names.take(pa.array(found)).combine_chunks(), names.take(pa.array(a)).combine_chunks()])
        dst = pa.concat_arrays([pa.nulls(len(found), pa.binary()), names.take(pa.array(b)).combine_chunks()])
        return pa.table([src, pa.array(np.append(links[found], np.zeros(len(a), np.int64))), dst], schema=out)

    return stored(rows.groupBy("block", "cell", "s", "t").applyInArrow(meet, "node binary, links long, other binary"), "embedding-links")


def near_duplicates(
    vectors: DataFrame, cosine: float = LEAST_COSINE, id_col: str = "vec_id", vec_col: str = "embedding", blocks: int = BLOCKS, chunk: int = CHUNK
) -> DataFrame:
    """(id, n_links, component): a row per row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing and are their own component; so do vectors of different length.
    Equal vectors are one node with a weight, so copies cost a row each. A row
    with a null id counts as a link of others; its component is the least id there,
    null if there is none. Repeated ids are vectors of their own but, being the
    same id, do not link their components. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = stored(_classes(vectors, id_col, vec_col), "embedding-rows")
    nodes = rows.where("node is not null").groupBy("node", "dim", "vec").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    nodes = stored(nodes, "embedding-nodes")
    found = None
    for dim in sorted(r[0] for r in nodes.select("dim").distinct().collect()):  # vectors of a table are of few lengths
        mine = nodes.where(F.col("dim") == dim)
        n, moments = _moments(mine, dim)
        plan = Plan(n, moments, cosine, blocks)
        _set_edges(plan, mine, n, chunk)
        part = _join(mine, plan, chunk)
        found = part if found is None else found.unionByName(part)
    alone = rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if found is None:
        return alone
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = stored(connected_components(found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst"))), "embedding-parts")
    tree = nodes.join(parts, "node").select("node", F.col("component").alias("root"), "least")
    least = tree.groupBy("root").agg(F.min("least").alias("low"))
    tree = tree.join(least, "root").select("node", "low")
    classes = nodes.select("node", "weight", "least").join(links, "node", "left").join(tree, "node", "left")
    classes = classes.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("low", "least").alias("component"))
    linked = rows.where("node is not null").join(classes, "node").select("id", "n_links", "component")
    return linked.unionByName(alone)


def _set_edges(plan: Plan, nodes: DataFrame, n: int, chunk: int) -> None:
    """Quantile edges of the grids, for cells of about ``chunk`` vectors, from all vectors."""
    axes = plan.grid_axes()
    per_axis = [max(1, round((n / chunk) ** (1 / len(a)))) for a in axes]
    if max(per_axis) == 1:
        plan.edges = [[np.zeros(0)] * len(a) for a in axes]
        return
    wanted = sorted({x for a in axes for x in a})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = plan.rotated(units(b.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(q[:, x]) for x in wanted], names=[f"x{x}" for x in wanted])

    table = nodes.select("vec").mapInArrow(run, ", ".join(f"x{x} double" for x in wanted))
    probs = sorted({i / p for p in per_axis for i in range(1, p)})
    found = dict(zip(wanted, table.approxQuantile([f"x{x}" for x in wanted], probs, 0.01)))
    at = {p: k for k, p in enumerate(probs)}
    plan.edges = [[np.unique([found[x][at[i / p]] for i in range(1, p)]) for x in a] for a, p in zip(axes, per_axis)]


def op9(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    return near_duplicates(vectors).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

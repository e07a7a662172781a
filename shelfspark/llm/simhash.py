"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most two of 64 bits are linked. The bits are put
into m groups with thresholds t_i >= -1 whose sum is 2 - m + 1; two fingerprints
within two bits then agree to within t_i on at least one group i. Groups hold
correlated bits, and a dynamic programme gives each the threshold (-1: not
probed) that makes the fewest signatures and candidates by the bits' statistics
over all fingerprints. Candidates are verified by ``bit_count(a ^ b)``.

A bucket of a group's value that holds more than ``dense`` fingerprints is not
paired: its members are keyed by themselves and their 64 one-bit neighbours. Two
values share such a key exactly if they differ in two bits or fewer, so a star
to the least member of each key links the same fingerprints in linear space.
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
from shelfspark.storage import bounded_batches, stored

BITS = 64
TAU = 2
SEED = 42
#: Shingles hashed at once, so that a text of any length needs little memory.
CHUNK = 200_000


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text (see ``fingerprints``)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(part)]
        ones += _ones(np.array([digest(g, SEED) for g in grams], np.uint64))
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit, the highest first."""
    return np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of the shingles that hash to ``hashes`` (unsigned 64 bits); zero of none."""
    ones = sum((_ones(hashes[at : at + CHUNK]) for at in range(0, len(hashes), CHUNK)), np.zeros(BITS, np.int64))
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per document, ``fp`` the fingerprint as a signed long.

    A-Z become lower case; words are runs of other than ASCII white space, and
    ``shingle`` of them are joined by a space (fewer: all there are). A bit is set
    if it is set in over half the shingles' XXH64 (seed 42), repeats included.
    A null text or one without words has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of rows, 64 x 64 counts of rows in which both bits are set) over all of ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            if b.num_rows:
                v = b.column(0).to_numpy(zero_copy_only=False).astype(">i8")
                bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        counts = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["k", "n"])

    rows = fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:  # always 4,097 rows
        flat[r["k"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _agreement(n: int, both: np.ndarray) -> np.ndarray:
    """P(two random rows agree on bits i and j); on the diagonal, on bit i."""
    p = both / max(n, 1)
    one = np.diag(p)
    a, b = one[:, None] - p, one[None, :] - p
    return p**2 + a**2 + b**2 + np.clip(1 - p - a - b, 0, 1) ** 2


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64 / m bits, each grown from a seed by its most correlated bits."""
    p = both / max(n, 1)
    one = np.diag(p)
    spread = np.sqrt(np.clip(one * (1 - one), 1e-12, None))
    corr = np.abs((p - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = -(-len(left) // (m - g))
        rest = sorted(left)
        seed = max(rest, key=lambda b: (corr[b, rest].max(), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(group)
    return groups


def _candidates(n: int, agree: np.ndarray, group: list[int]) -> list[float]:
    """Estimated pairs within threshold 0 and 1 on the group, bits in a chain of dependence."""
    p = agree[group[0], group[0]]
    for k, b in enumerate(group[1:], 1):
        p *= max(agree[b, c] / agree[c, c] for c in group[:k])
    odds = sum((1 - agree[b, b]) / agree[b, b] for b in group)
    pairs = n * (n - 1) / 2
    return [pairs * p, pairs * min(1.0, p * (1 + odds))]


def allocate(n: int, both: np.ndarray, tau: int = TAU, most: int = 6) -> list[tuple[list[int], int]]:
    """The cheapest [(bits, threshold)]: groups that are probed, thresholds 0 or 1.

    For each number of groups, a dynamic programme deals tau + 1 units out (a
    group with u units has threshold u - 1). The cost counts signature rows and
    estimated candidates.
    """
    agree, best = _agreement(n, both), None
    for m in range((tau + 2) // 2, most + 1):
        groups = group_bits(n, both, m)
        costs = []
        for g in groups:
            near0, near1 = _candidates(n, agree, g)
            costs.append([0.0, n + near0, n * (2 + len(g) / 2) + near1])
        plans: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, units) in plans.items():
                for u, more in enumerate(c):
                    if used + u <= tau + 1 and (used + u not in step or cost + more < step[used + u][0]):
                        step[used + u] = (cost + more, [*units, u])
            plans = step
        cost, units = plans[tau + 1]
        if best is None or cost < best[0]:
            best = (cost, [(g, u - 1) for g, u in zip(groups, units) if u])
    return best[1]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << (BITS - 1 - b) for b in bits)
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def hamming_links(fps: DataFrame, dense: int = 64) -> DataFrame:
    """(src, dst): links among the rows of ``fps(node, fp)``, whose fps are distinct.

    Rows within two bits of each other are in one component of the links; outside
    dense buckets every such pair is a link itself.
    """
    plan = allocate(*bit_statistics(fps))
    sigs = []
    for k, (bits, t) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(_signed(bits)))
        keys = F.array(F.struct(own.alias("key"), F.lit(False).alias("probe")))
        if t == 1:  # the side with a zero bit looks for the one that has it set
            flips = F.array(*(F.lit(_signed([b])) for b in bits))
            free = F.filter(flips, lambda b: F.col("fp").bitwiseAND(b) == 0)
            keys = F.concat(keys, F.transform(free, lambda b: F.struct(own.bitwiseOR(b).alias("key"), F.lit(True).alias("probe"))))
        sigs.append(F.transform(keys, lambda s, k=k: F.struct(F.lit(k).alias("part"), s["key"].alias("key"), s["probe"].alias("probe"))))
    rows = fps.select("node", "fp", F.explode(F.concat(*sigs)).alias("s")).select("node", "fp", "s.part", "s.key", "s.probe")
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(rows.join(sizes, ["part", "key"]), "simhash-buckets")
    a = rows.where(F.col("n") <= dense)
    b = a.where(~F.col("probe")).select("part", "key", F.col("node").alias("dst"), F.col("fp").alias("fp2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= TAU
    pairs = a.join(b, ["part", "key"]).where((F.col("probe") | (F.col("node") < F.col("dst"))) & (F.col("node") != F.col("dst")) & near)
    crowd = rows.where(F.col("n") > dense).select("node", "fp").distinct()
    around = F.concat(F.array(F.col("fp")), F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed([b]))) for b in range(BITS))))
    spread = crowd.select("node", F.explode(around).alias("key"))
    star = spread.groupBy("key").agg(F.min("node").alias("dst"), F.count("*").alias("n")).where("n > 1")
    star = spread.join(star, "key").where(F.col("node") != F.col("dst")).select(F.col("node").alias("src"), "dst").distinct()
    return pairs.select(F.col("node").alias("src"), "dst").unionByName(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, dense: int = 64) -> DataFrame:
    """(id, fp, component): each document's fingerprint and the least id it reaches by links.

    Works over whole texts; equal fingerprints (copies, or all texts without
    words) are one node of the graph, so a group of any size costs one row there.
    A row with a null id gets its class's component; if the class has no other
    row, null. Repeated ids are each a row and linked with one another. Extra
    columns are ignored; an empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("node"))
    nodes = stored(nodes, "simhash-nodes")
    known = nodes.where(F.col("node").isNotNull())
    # ids that occur with several fingerprints tie these together
    tied = fps.where(F.col("id").isNotNull()).join(known, "fp").where(F.col("id") != F.col("node"))
    tied = tied.join(known.select(F.col("node").alias("id")), "id").select(F.col("id").alias("src"), F.col("node").alias("dst"))
    parts = connected_components(hamming_links(known, dense).unionByName(tied))
    classes = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return fps.join(classes, "fp").select("id", "fp", "component")


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )

"""Near-duplicate documents by exact similarity of their five-word shingles.

Two documents are linked if the Jaccard similarity of their sets of shingles is
4/5 or more. Candidates come first from SimHash: fingerprints of the sets within two
bits, verified by the whole sets. What SimHash leaves in different components may
still be similar, so the exact join below completes it; it verifies no pair that
SimHash has put together.

Such sets of sizes n <= m, put in any one order, share a shingle among the first
n // 9 + 1 of the smaller ("index") and the first m // 5 + 1 of the larger, so
candidates are found by joining these prefixes, and none is lost.

Prefixes are first taken in the order of the shingles' hashes. Documents that share
a bucket of more than ``dense`` of them are joined again among themselves, with the
keys of dense buckets put last in the order, until no other key is dense. Any order
is exact, so that list of keys may be cut. What is dense in the end is a star to its
least member, and only what the links leave in different components is then paired.

Candidates must first be able to reach 4/5 by what their hash-ordered prefixes share
and all that follows these; then they are verified by the whole sets (64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.simhash import fingerprint, hamming_links
from shelfspark.operators.graph import connected_components
from shelfspark.storage import bounded_batches, stored

SHINGLE = 5
SEED = 42
#: Keys that are put last at most (1.6 MB for each task), and how often prefixes are taken at most.
USUAL = 200_000
ROUNDS = 6
#: Hashes in an Arrow batch, about.
HELD = 1 << 19


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``shingle`` words (of all words if there are fewer; none of none)."""
    if not words:
        return np.zeros(0, np.int64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digests = b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED)))
    return np.unique(np.frombuffer(digests, ">i8").astype(np.int64))


def _later(own: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """``own`` with its members of ``usual`` put last; both are sorted, and the longer is only searched."""
    if not len(usual):
        return own
    last = usual[np.minimum(np.searchsorted(usual, own), len(usual) - 1)] == own
    return np.concatenate([own[~last], own[last]])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sets(docs: DataFrame, usual: np.ndarray | None) -> DataFrame:
    """(id, digest of the words, fp, n, keys) of ``docs(id, text)``: the longer prefix with ``usual`` keys, sorted, last; all n shingles if null.

    ``fp`` is the SimHash fingerprint of all n shingles as a signed long, where ``usual`` is empty; else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests, fps, sizes, keys, held = [], [], [], [], [], 0
            for k, x in enumerate(b.column(1)):
                words = _words(x.as_py())
                own = shingles(words)
                ids.append(k)
                digests.append(xxhash.xxh128_digest(b" ".join(words)))
                fps.append(np.uint64(fingerprint(own.view(np.uint64))).astype(np.int64) if usual is not None and not len(usual) else None)
                sizes.append(len(own))
                if usual is not None:
                    own = _later(own, usual)[: len(own) // 5 + 1]
                keys.append(own)
                held += len(keys[-1])
                if held > HELD or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), _lists(keys)], names=["id", "digest", "fp", "n", "keys"])
                    ids, digests, fps, sizes, keys, held = [], [], [], [], [], 0

    bounded_batches(docs.sparkSession)
    kinds = {"id": docs.schema["id"].dataType, "digest": T.BinaryType(), "fp": T.LongType(), "n": T.IntegerType(), "keys": T.ArrayType(T.LongType())}
    return docs.mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


def _sized(sets: DataFrame) -> DataFrame:
    """Rows (node, n, key, index) of the prefixes ``sets(node, n, keys)`` in buckets of two or more, of which ``size`` holds the number."""
    rows = sets.select("node", "n", F.posexplode("keys").alias("at", "key"))
    rows = rows.select("node", "n", "key", (F.col("at") <= F.floor(F.col("n") / 9)).alias("index"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return stored(rows.join(sizes, "key"), "near-buckets")


def _pairs(rows: DataFrame, more: F.Column | None = None) -> DataFrame:
    """(src, dst): the smaller set by its index rows against the larger, if their sizes allow 4/5."""
    b = rows.select("key", *(F.col(c).alias(f"{c}2") for c in rows.columns if c != "key"))
    order = F.struct("n", "node") < F.struct("n2", "node2")
    fits = F.col("index") & order & (F.col("n") * 5 >= F.col("n2") * 4)
    found = rows.join(b, "key").where(fits if more is None else fits & more)
    return found.select(F.col("node").alias("src"), F.col("node2").alias("dst")).distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with n1, keys1, n2 and keys2 of ``sets(node, n, keys)``."""
    ends = stored(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct(), "near-ends")
    some = stored(sets.join(ends, "node", "left_semi"), "near-sets")
    return pairs.join(some.toDF("src", "n1", "keys1"), "src").join(some.toDF("dst", "n2", "keys2"), "dst")


def _verified(docs: DataFrame, prefixes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs whose sets are similar enough."""
    both = F.size(F.array_intersect("keys1", "keys2"))
    until = F.least(F.element_at("keys1", -1), F.element_at("keys2", -1))
    after = lambda n, keys: F.col(n) - F.size(F.filter(keys, lambda k: k <= F.col("until")))
    found = _with_sets(stored(pairs, "near-candidates"), prefixes).withColumn("until", until)
    most = both + F.least(after("n1", "keys1"), after("n2", "keys2"))
    pairs = stored(found.where(most * 9 >= (F.col("n1") + F.col("n2")) * 4).select("src", "dst"), "near-likely")
    ends = stored(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct(), "near-ends")
    whole = _sets(docs.join(ends, "id", "left_semi"), None).select(F.col("id").alias("node"), "n", "keys").dropDuplicates(["node"])
    found = _with_sets(pairs, whole).where(both * 9 >= (F.col("n1") + F.col("n2")) * 4)
    return stored(found.select("src", "dst"), "near-links")


def _close(docs: DataFrame, prefixes: DataFrame, fps: DataFrame) -> DataFrame:
    """(src, dst) among the nodes of ``fps(node, fp)``: similar ones whose fingerprints SimHash links.

    Nodes of one fingerprint are linked to their least, and those of different ones by it.
    """
    least = stored(fps.groupBy("fp").agg(F.min("node").alias("dst")), "near-fingerprints")
    same = fps.join(least, "fp").where("node != dst").select(F.col("node").alias("src"), "dst")
    return _verified(docs, prefixes, hamming_links(least.select(F.col("dst").alias("node"), "fp")).unionByName(same).distinct())


def _links(docs: DataFrame, prefixes: DataFrame, dense: int, fps: DataFrame) -> DataFrame:
    """(src, dst) among the nodes of ``prefixes``: links whose components are those of all similar pairs."""
    close = _close(docs, prefixes, fps)
    parts = connected_components(close)
    rows, usual, pairs = _sized(prefixes), np.zeros(0, np.int64), []
    for k in range(ROUNDS):
        many = rows.where(F.col("size") > dense)
        pairs.append(_pairs(rows.where(F.col("size") <= dense)))
        keys = many.select("key", "size").distinct().orderBy(F.desc("size"), "key").limit(USUAL).select("key").toPandas()["key"].to_numpy(np.int64)
        more = np.setdiff1d(keys, usual)[: USUAL - len(usual)]
        if not len(more) or k == ROUNDS - 1:
            break
        usual = np.union1d(usual, more)
        crowd = stored(many.select(F.col("node").alias("id")).distinct(), "near-crowd")
        rows = _sized(stored(_sets(docs.join(crowd, "id", "left_semi"), usual).select(F.col("id").alias("node"), "n", "keys"), "near-crowd-sets"))
    star = many.join(many.groupBy("key").agg(F.min("node").alias("dst")), "key").where("node != dst")
    pairs.append(star.select(F.col("node").alias("src"), "dst"))
    links = close.unionByName(_verified(docs, prefixes, _apart(reduce(DataFrame.unionByName, pairs).distinct(), parts)))
    if not len(keys):
        return links
    many = many.join(connected_components(links), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    split = many.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a != b").select("key")
    rest = stored(_pairs(stored(many.join(split, "key"), "near-rest"), F.col("part") != F.col("part2")), "near-rest-pairs")
    return links if rest.isEmpty() else links.unionByName(_verified(docs, prefixes, rest))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose ends are not in one of ``parts(node, component)``."""
    a, b = parts.toDF("src", "part"), parts.toDF("dst", "part2")
    rows = pairs.join(a, "src", "left").join(b, "dst", "left")
    return rows.where(F.coalesce(F.col("part") != F.col("part2"), F.lit(True))).select("src", "dst")


def near_duplicates(docs: DataFrame, dense: int = 16) -> DataFrame:
    """(id, component) of each id of ``docs(id, text)``: the least id that it reaches by links.

    Words are runs of other than ASCII white space, A-Z as lower case; texts of the
    same words (null and no words included) are copies. Ids are not null, and rows
    of the same id have the same text.
    """
    sets = stored(_sets(docs, np.zeros(0, np.int64)), "near-all")
    nodes = stored(sets.groupBy("digest").agg(F.min("id").alias("node")), "near-nodes")
    one = sets.join(nodes, "digest").where("id = node").dropDuplicates(["digest"])
    one = stored(one.select("node", "n", "keys", "fp"), "near-prefixes")
    parts = connected_components(_links(docs, one.drop("fp"), dense, one.select("node", "fp")))
    classes = nodes.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return sets.select("id", "digest").join(classes, "digest").select("id", "component")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component of near-duplicates, the row with the least doc_id.

    A null id counts as the least. Of rows that share the least id, that with the
    least text hash stays, and of repeated rows one. Texts are not shuffled for it
    where the ids of what goes or repeats are few enough for Spark to broadcast.
    """
    own = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    rows = docs.select(own.alias("own__"), F.struct(*docs.columns).alias("row__"))
    found = near_duplicates(docs.select(own.alias("id"), "text")).groupBy("id").agg(F.min("component").alias("component"), F.count("*").alias("n"))
    other = stored(found.where("id != component OR n > 1").select("id", (F.col("id") == F.col("component")).alias("stays")), "near-other")
    alone = rows.join(other, F.col("own__").eqNullSafe(F.col("id")), "left_anti").select("row__.*")
    again = other.where("stays")
    if again.isEmpty():
        return alone
    return alone.unionByName(rows.join(again, F.col("own__").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["own__"]).select("row__.*"))

"""Packing of documents into fixed-length sequences by harmonic classes.

Class k holds pieces of at most capacity // k ids, k to a bin. Documents may be
cut, so each is cut to lengths that fill their class: first whole bins (class 1),
then greedily the longest capacity // k that still fits, until fewer than
``tail`` ids are left, which are a piece of class capacity // length. A full bin
of any class then wastes less than 1 / k of a piece.

Bins of a class are filled in parallel: pieces are numbered within (class,
bucket) groups, whose counts give each group its first number, and piece i of
class k lies in bin i // k. Only the last, partly filled bin of each class is
left; these pieces (fewer than the sum of all k, whatever the input) are packed
together first-fit by decreasing length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.tokens import encoder, vocabulary_path
from shelfspark.storage import bounded_batches, stored

CAPACITY = 2048
#: A rest of fewer ids is not cut again.
TAIL = 16
END_ID = 1
#: sequence_id = bin * (capacity * 2) + class; class 0 holds the leftovers.
BUCKETS = 64


def cut(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[tuple[int, int]]:
    """(length, class) of the pieces that n ids are cut to, in order."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        size = rest
        if rest >= tail:
            k = -(-capacity // (rest + 1))
            while capacity // k > rest:  # the floor of the quotient can lie one class further
                k += 1
            size = capacity // k
        pieces.append((size, capacity // size))
        rest -= size
    return pieces


def pieces_of(
    docs: DataFrame, path: str, end_id: int, capacity: int, tail: int, buckets: int, id_col: str, text_col: str
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, k, bucket (dealt in turn)."""
    kind = docs.schema[id_col].dataType
    longs = ("start", "length", "ids_crc32", "doc_tokens", "k", "bucket")
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, made = encoder(path), 0
        for b in batches:
            row, out = [], []
            for i, text in enumerate(b.column(1)):
                ids = np.append(enc.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                at = 0
                for size, k in cut(len(ids), capacity, tail):
                    row.append(i)
                    out.append((at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids), k, made % buckets))
                    at += size
                    made += 1
            cols = np.array(out, np.int64).reshape(-1, len(longs)).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *map(pa.array, cols)], names=["id", *longs])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of pieces in falling order of length."""
    room, where, offset = [], [], []
    at = last = 0
    for n in lengths:
        at = at if n == last else 0  # bins before it had no room for this length
        last = n
        while at < len(room) and room[at] < n:
            at += 1
        if at == len(room):
            room.append(capacity)
        where.append(at)
        offset.append(capacity - room[at])
        room[at] -= n
    return where, offset


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    tail: int = TAIL,
    buckets: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A document's ids are the tokenizer's (no special tokens added) and ``end_id``;
    a null or empty text is ``end_id`` alone. Each row of ``docs`` is packed, also
    with a null or repeated id. Pieces of a sequence leave no gap from offset 0;
    sequences are shorter than ``capacity`` by their padding. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(pieces_of(docs, vocabulary or vocabulary_path(), end_id, capacity, tail, buckets, id_col, text_col), "packing-pieces")
    sizes = rows.groupBy("k", "bucket").agg(F.count("*").alias("n"))  # at most classes x buckets rows
    by_class = W.partitionBy("k").orderBy("bucket")
    firsts = sizes.select("k", "bucket", (F.sum("n").over(by_class) - F.col("n")).alias("first"), F.sum("n").over(W.partitionBy("k")).alias("total"))
    own = W.partitionBy("k", "bucket").orderBy("id", "start", "ids_crc32", "doc_tokens")
    numbered = rows.withColumn("i", F.row_number().over(own) - 1).join(firsts, ["k", "bucket"]).withColumn("i", F.col("i") + F.col("first"))
    numbered = stored(numbered.withColumn("full", F.col("i") < F.col("total") - F.col("total") % F.col("k")).drop("bucket", "first", "total"), "packing-numbered")
    keep = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    step = 2 * capacity
    whole = numbered.where("full").select(
        *keep, (F.expr("i div k") * step + F.col("k")).alias("sequence_id"), (F.col("i") % F.col("k") * F.col("length")).alias("offset")
    )
    rest = numbered.where(~F.col("full")).select(*keep)
    kind = numbered.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def leftovers(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in ("id", "start", "ids_crc32"))])
        where, offset = _first_fit(table["length"].to_pylist(), capacity)
        table = table.append_column("sequence_id", pa.array([w * step for w in where], pa.int64()))
        return table.append_column("offset", pa.array(offset, pa.int64()))

    return whole.unionByName(rest.groupBy(F.lit(0).alias("all")).applyInArrow(leftovers, schema))


def op7(docs: DataFrame) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return pack(docs).withColumnRenamed("id", "doc_id")

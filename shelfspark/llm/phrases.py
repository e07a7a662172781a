"""Phrases that occur together more often than their parts suggest, by language.

Texts are split into pieces (runs of words between punctuation), and identical pieces
become one row with a multiplicity. Phrases of one word, then of two and so on are
counted, weighted by it: tasks add up what they meet, the rows are dealt into hash
buckets, and DuckDB counts each bucket, on disk where memory does not suffice.

A phrase can only be frequent if its parts are, so a task offers only pairs of words that
both pass a bit map of the frequent words, and longer phrases whose neighbouring pairs all
pass a map of the frequent pairs. A map is of bounded size: with very many frequent
phrases it lets more through, and no count changes. The parts a candidate is cut into are looked up by requests shuffled to the
counts; requests for one part are spread over several copies of its count. Copies, requests
and inner phrases are many rows from small files, so their joins are merge joins, and none of
them is broadcast by the size of its files.
"""

from __future__ import annotations

import itertools
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlparse

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.storage import bounded_batches, new_path, stored

LONGEST, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer one that holds it has at least so many hundredths of its occurrences.
COVERED = 80
FACTOR = 2_000_000
#: Bits of the map of frequent phrases: so many for each, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Pieces that a task adds up before it passes them on, and the bytes of pieces whose phrases it adds up.
HELD, CHUNK_BYTES = 200_000, 6_000_000
#: Memory of DuckDB in a task; what does not fit goes to disk.
MEMORY = "256MB"
#: Copies of each count that requests are spread over.
SALTS = 16

#: An odd multiplier of hashes.
SPREAD = 0x9E3779B97F4A7C15
# A-Z to a-z, a tab to a space, and the characters that part pieces to a line feed.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: A row is a key (how long the language is, the language, the words) and a count.
GRAM, NAMES = "key binary, f long", ["key", "f"]
FREQUENT = "lang string, phrase binary, f long, slot long"


def _prefix(lang: str) -> bytes:
    own = lang.encode("utf-8", "surrogatepass")
    return len(own).to_bytes(4, "big") + own


def _cut(key: bytes) -> int:
    """Where a key's words begin."""
    return 4 + int.from_bytes(key[:4], "big")


def split_pieces(text: bytes) -> Iterator[bytes]:
    """Pieces of a text with words parted by one space; pieces without a word are left out."""
    for piece in text.translate(TABLE).split(b"\n"):
        if piece := piece.strip(b" "):
            yield piece if b"  " not in piece else b" ".join(w for w in piece.split(b" ") if w)


def _rows(counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], NAMES)


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(key, f): distinct pieces and how often each occurs. A null language is ``und``; a null text has none."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                head = _prefix(lang)
                for piece in split_pieces(text.as_py()):
                    piece = head + piece
                    counts[piece] = counts.get(piece, 0) + 1
                if len(counts) >= HELD:
                    yield _rows(counts)
                    counts = {}
        yield _rows(counts)

    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, GRAM).groupBy("key").agg(F.sum("f").alias("f"))


def word_totals(found: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        for b in batches:
            for key, f in zip(*(c.to_pylist() for c in b.columns)):
                at = _cut(key)
                sums[key[:at]] = sums.get(key[:at], 0) + f * (key.count(b" ", at) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([k[4:] for k in sums], pa.binary()), pa.array(sums.values(), pa.int64())], ["lang", "n"])

    return found.select(*NAMES).mapInArrow(run, "lang binary, n long").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("n").alias("n"))


class _Words(dict):
    """Numbers of words in the order they are met, and a hash of each."""

    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def _slot(head: bytes, hashes: np.ndarray) -> np.ndarray:
    """Places in the map, of phrases of a language, by what ``_hash`` gives."""
    x = hashes ^ np.uint64(zlib.crc32(head) * SPREAD & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(SPREAD)
    return ((x ^ (x >> np.uint64(29))) & np.uint64(MOST_BITS - 1)).astype(np.int64)


def _hash(of_words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring words from the words' hashes."""
    h = of_words[: len(of_words) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(SPREAD) + of_words[k : len(of_words) - n + 1 + k]
    return h


def _added_up(head: bytes, found: list[bytes], f: list[int], sizes: list[int], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The phrases of so many words in these pieces, each with the sum of its pieces' f.

    With a map: those whose parts of a word less pass it (two words), or whose neighbouring
    pairs of words do (more).
    """
    words, names, long = [], _Words(), []
    for piece in found:
        mine = piece.split(b" ")
        long.append(len(mine))
        words += mine
    ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    ends = np.repeat(np.cumsum(long), long)
    weights = np.repeat(np.array(f, np.int64), long)
    spelt = list(names)
    if bits is not None:
        part = 1 if max(sizes) == 2 else 2
        slot = _slot(head, _hash(np.array(names.hashes, np.uint64)[ids], part)) & (len(bits) * 8 - 1)
        ok = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
    for n in sizes:
        at = np.flatnonzero(np.arange(len(ids)) + n <= ends)
        if bits is not None:
            at = at[np.logical_and.reduce([ok[at + k] for k in range(n - part + 1)])] if len(at) else at
        code = ids[at]
        for k in range(1, n):  # numbers of phrases from those of their beginnings
            if k > 1:
                code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            code = code << 32 | ids[at + k]
        order = np.argsort(code)
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        sums = np.add.reduceat(weights[at][order], first) if len(first) else np.zeros(0, np.int64)
        columns = [map(spelt.__getitem__, ids[at[order[first]] + k].tolist()) for k in range(n)]
        phrases = list(map(head.__add__, columns[0] if n == 1 else map(b" ".join, zip(*columns))))
        yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(sums, pa.int64())], NAMES)


def _offered(found: DataFrame, sizes: list[int], frequent: bytes | None) -> DataFrame:
    """Phrases of so many words of the pieces, added up by chunks, that pass the map."""
    shared = found.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8) if shared.value else None
        held: dict[bytes, tuple[list[bytes], list[int]]] = {}
        size: dict[bytes, int] = {}
        for b in batches:
            for key, f in zip(*(c.to_pylist() for c in b.columns)):
                at = _cut(key)
                head = key[:at]
                mine = held.setdefault(head, ([], []))
                mine[0].append(key[at:])
                mine[1].append(f)
                size[head] = size.get(head, 0) + len(key)
                if size[head] >= CHUNK_BYTES:
                    size[head] = 0
                    yield from _added_up(head, *held.pop(head), sizes, bits)
        for head, mine in held.items():
            yield from _added_up(head, *mine, sizes, bits)

    return found.select(*NAMES).mapInArrow(run, GRAM)


def spill_folder(spark: SparkSession) -> str | None:
    """Where tasks may keep DuckDB's overflow: the shared folder if it is mounted; None stands for the folders Spark spills to."""
    at = urlparse(new_path(spark, "phrase-spill"))
    return at.path if at.scheme in ("", "file") else None


def frequent_phrases(offered: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f, slot) of phrases that occur ``least`` times or more; each hash bucket is counted by DuckDB."""
    folder = spill_folder(offered.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is None:
            return
        at = folder or os.environ.get("SPARK_LOCAL_DIRS", os.environ.get("LOCAL_DIRS", "")).split(",")[0] or os.getcwd()
        own = os.path.join(at, uuid.uuid4().hex)
        os.makedirs(own, exist_ok=True)  # DuckDB makes its folder only in one that is there
        con = duckdb.connect(config={"memory_limit": MEMORY, "temp_directory": own, "threads": 1, "preserve_insertion_order": False})
        try:
            grams = pa.RecordBatchReader.from_batches(head.schema, itertools.chain([head], batches))
            con.register("grams", grams)
            counted = con.sql(f"SELECT key, sum(f)::BIGINT AS f FROM grams GROUP BY key HAVING sum(f) >= {int(least)}")
            for b in counted.to_arrow_reader(50_000):
                keys = b.column(0).to_pylist()
                heads, phrases = [k[: _cut(k)] for k in keys], [k[_cut(k) :] for k in keys]
                hashes = np.array([reduce(lambda h, w: (h * SPREAD + xxhash.xxh3_64_intdigest(w)) % (1 << 64), p.split(b" "), 0) for p in phrases], np.uint64)
                slots, of = np.zeros(len(keys), np.int64), np.array(heads, object)
                for head in set(heads):
                    slots[of == head] = _slot(head, hashes[of == head])
                langs = pa.array([h[4:].decode("utf-8", "surrogatepass") for h in heads], pa.string())
                yield pa.RecordBatch.from_arrays([langs, pa.array(phrases, pa.binary()), b.column(1).cast(pa.int64()), pa.array(slots)], ["lang", "phrase", "f", "slot"])
        finally:
            con.close()
            shutil.rmtree(own, ignore_errors=True)

    return offered.repartition("key").mapInArrow(run, FREQUENT)


def _bit_map(counted: DataFrame) -> bytes | None:
    """The map of these phrases' slots, None without any; at most MOST_BITS."""
    n = counted.count()
    if not n:
        return None
    bits = min(MOST_BITS, max(1 << 15, 1 << (n * BITS_EACH - 1).bit_length()))
    place = F.col("slot").bitwiseAND(F.lit(bits - 1)) + 1
    parts = counted.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    out = bytearray(bits // 8)
    for r in parts.collect():  # bits / 32,768 rows of 4 KB
        out[(r.b - 1) * 4096 : r.b * 4096] = r.m
    return bytes(out)


def counts(found: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f, words): the frequent phrases of 1 to ``longest`` words of distinct pieces."""
    levels, frequent = [], None
    for sizes in ([1], [2], list(range(3, longest + 1))):
        sizes = [n for n in sizes if n <= longest]
        if not sizes:
            break
        level = stored(frequent_phrases(_offered(found, sizes, frequent), least), "phrase-counts")
        phrase = F.col("phrase").cast("string")
        levels.append(level.select("lang", phrase.alias("phrase"), "f", F.size(F.split(phrase, " ")).alias("words")))
        if sizes[-1] == longest or (frequent := _bit_map(level)) is None:
            break  # what is longer is not frequent either
    return reduce(DataFrame.unionByName, levels)


def _scored(candidates: DataFrame, counted: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    side = lambda s, part: F.struct(F.lit(s).alias("side"), F.array_join(part, " ").alias("part"))
    sides = F.array(side("l", F.slice(words, 1, F.col("k"))), side("r", F.slice(words, F.col("k") + 1, F.col("words") - F.col("k"))))
    asked = cut.select("lang", "phrase", "a", "k", F.inline(sides), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    told = counted.select("lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    answers = asked.join(told.hint("merge"), ["lang", "part", "salt"])
    by_cut = answers.groupBy("lang", "phrase", "a", "k").agg(*(F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lr"))
    score = F.expr(f"(cast({FACTOR} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    least = by_cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x"))
    return least.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A null text is empty and a null language ``und``; a table without any text, or without
    a frequent phrase, gives an empty result. Rows count as they are, repeats included;
    ties go by count and then by the phrase's bytes. Other columns are ignored.
    """
    found = stored(pieces(docs, lang_col, text_col), "phrase-pieces")
    totals = word_totals(found)
    counted = stored(counts(found, longest, least), "phrase-counts")
    candidates = counted.where("words >= 2").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    holders = candidates.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    hundredfold = lambda c: F.col(c).cast("decimal(20,0)")
    gone = F.coalesce(hundredfold("longer") * 100 >= hundredfold("a") * covered, F.lit(False))
    rest = candidates.join(holders.hint("merge"), ["lang", "phrase"], "left").where(~gone).select("lang", "phrase", "words", "a")
    scored = _scored(rest, counted)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # first the best of each of several shares of a language, then the best of those
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    share = W.partitionBy("lang", F.pmod(F.xxhash64("phrase", "a"), F.lit(shares))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(docs: DataFrame) -> DataFrame:
    return collocations(docs)


# Every phrase of every piece, without the map and without multiplicities.
OP12_SQL = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^ \\t]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)
), gram AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM piece, range(1, {LONGEST + 1}) t(m)
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM gram GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= {LEAST}
), inside AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda k: list_transform(range(1, m - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase FROM c WHERE m > 2
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp
  FROM c LEFT JOIN longer USING (lang, phrase), range(1, m) t(k) WHERE longer IS NULL OR 100 * longer::HUGEINT < {COVERED} * a::HUGEINT
), scored AS (
  SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, (({FACTOR} * a::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN total USING (lang) WHERE rank <= {TOP}
"""

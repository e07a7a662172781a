"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: each task writes segments of a bounded
number of words, and a segment holds for every term its sorted positions in the
segment (documents one after another, with a gap between). Terms are those of
the benchmark, and only postings are stored that some window of the benchmark
could use: a window of n words needs n postings of such windows' terms within
n + slop words. A window is looked up in a segment by intersecting its terms'
lists, each shifted by the term's offset, from the rarest term on.

A benchmark is worked through in blocks of a bounded number of words, so what is
sent to the tasks is bounded too.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.storage import bounded_batches, stored

WINDOW = 10
#: Words of the documents in a segment, about; a longer document is a segment of its own.
SEGMENT_WORDS = 1_500_000
#: Words of the benchmark in a block, about; a longer item is a block of its own.
BLOCK_WORDS = 300_000

# A-Z to a-z; 0-9, a-z and bytes of other than ASCII characters stay; the rest separates words.
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text in UTF-8; none if it is null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(KEEP).split()


@dataclass
class Block:
    """The distinct windows of some benchmark items."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], int] = field(default_factory=dict)
    items: list[set[str]] = field(default_factory=list)  # by window
    words: int = 0

    def add(self, item: str, text: str | None, size: int) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
        self.words += len(ids)
        for at in range(max(1, len(ids) - size + 1)) if ids else ():
            k = self.windows.setdefault(tuple(ids[at : at + size]), len(self.windows))
            if k == len(self.items):
                self.items.append(set())
            self.items[k].add(item)


def blocks(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Blocks of the benchmark, read a partition at a time."""
    now = Block()
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_col)
    for item, text in rows.toLocalIterator():
        now.add(item, text, size)
        if now.words >= block_words:
            yield now
            now = Block()
    if now.windows:
        yield now


def _usable(ids: np.ndarray, of_length: dict[int, np.ndarray], slop: int) -> np.ndarray:
    """Which of a document's words (term or -1) may be part of a match; of_length: by window length, the terms it has."""
    keep = np.zeros(len(ids), bool)
    for n, has in of_length.items():
        span = n + slop
        mine = has[ids]  # has[-1] is false
        total = np.concatenate(([0], np.cumsum(np.append(mine, np.zeros(slop, bool)))))
        enough = np.flatnonzero(total[span:] - total[:-span] >= n) if len(total) > span else ()
        if len(enough):
            edge = np.zeros(len(ids) + span + 1, np.int32)
            np.add.at(edge, enough, 1)
            np.add.at(edge, enough + span, -1)
            keep |= (np.cumsum(edge)[: len(ids)] > 0) & mine
    return keep


def build_index(docs: DataFrame, block: Block, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Rows (segment, term, positions) and, with term -1, a row per document: segment, id, base (first position), n_words, key.

    ``key`` is a 128-bit hash of the text. Written to the shared folder. Positions
    are little-endian 64-bit integers.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    vocabulary, gap = block.vocabulary, WINDOW + slop + 1
    of_length = {}
    for w in block.windows:
        has = of_length.setdefault(len(w), np.zeros(len(vocabulary) + 1, bool))
        has[list(w)] = True
    gap = max(gap, max(of_length, default=0) + slop + 1)
    schema = T.StructType(
        [
            T.StructField("segment", T.StringType()), T.StructField("term", T.IntegerType()), T.StructField("positions", T.BinaryType()),
            T.StructField("id", kind), T.StructField("base", T.LongType()), T.StructField("n_words", T.LongType()),
            T.StructField("key", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            names = pa.schema([("segment", pa.string()), ("term", pa.int32()), ("positions", pa.binary()), ("id", b.schema.field(0).type), ("base", pa.int64()), ("n_words", pa.int64()), ("key", pa.binary())])
            begin = base = 0
            bases, sizes, keys, terms, places = [], [], [], [], []
            for i, x in enumerate(b.column(1)):
                text = x.as_py() or ""
                mine = words(text)
                keys.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                if mine:
                    ids = np.fromiter((get(w, -1) for w in mine), np.int32, len(mine))
                    keep = np.flatnonzero(_usable(ids, of_length, slop))
                    terms.append(ids[keep])
                    places.append(keep + base)
                bases.append(base)
                sizes.append(len(mine))
                base += len(mine) + gap
                if base >= segment_words or i + 1 == b.num_rows:
                    segment = uuid.uuid4().hex
                    t = np.concatenate(terms) if terms else np.zeros(0, np.int32)
                    p = np.concatenate(places).astype("<i8") if places else np.zeros(0, "<i8")
                    order = np.argsort(t, kind="stable")
                    t, p = t[order], p[order]
                    known, at = np.unique(t, return_index=True)
                    lists = [x.tobytes() for x in np.split(p, at[1:])] if len(known) else []
                    n, m = len(bases), len(known)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([segment] * (n + m)), pa.array([-1] * n + known.tolist(), pa.int32()), pa.array([None] * n + lists, pa.binary()),
                            pa.concat_arrays([b.column(0).slice(begin, n), pa.nulls(m, b.schema.field(0).type)]), pa.array(bases + [None] * m, pa.int64()), pa.array(sizes + [None] * m, pa.int64()),
                            pa.array(keys + [None] * m, pa.binary()),
                        ],
                        schema=names,
                    )
                    begin, base = i + 1, 0
                    bases, sizes, keys, terms, places = [], [], [], [], []

    return stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "positional-index")


def exact(lists: dict[int, np.ndarray], window: tuple[int, ...]) -> np.ndarray:
    """Positions at which a window's words follow one another, by intersection from the rarest term on."""
    order = sorted(range(len(window)), key=lambda k: len(lists[window[k]]))
    at = lists[window[order[0]]] - order[0]
    for k in order[1:]:
        if not len(at):
            break
        have, want = lists[window[k]], at + k
        spot = np.searchsorted(have, want)
        at = at[(spot < len(have)) & (have[np.minimum(spot, len(have) - 1)] == want)]
    return at


def proximity(lists: dict[int, np.ndarray], window: tuple[int, ...], slop: int) -> np.ndarray:
    """Starts of all spans of len(window) + slop words that hold every word of the window as often as it does, in any order."""
    need: dict[int, int] = {}
    for t in window:
        need[t] = need.get(t, 0) + 1
    span, order = len(window) + slop, sorted(need, key=lambda t: len(lists[t]))
    at = np.unique((lists[order[0]][:, None] - np.arange(span)).ravel())
    for t in order:
        have = lists[t]
        at = at[np.searchsorted(have, at + span) - np.searchsorted(have, at) >= need[t]]
    return at


def search(index: DataFrame, block: Block, slop: int = 0) -> DataFrame:
    """(segment, base, n_hit, spans, items): the documents of an index in which windows occur.

    ``spans`` are the merged ranges of hit words (first, end exclusive) and
    ``items`` the ids of the matched items. With ``slop`` the spans of proximity
    matches count as hit too.
    """
    windows = list(block.windows)
    width = max(map(len, windows), default=1)
    table = np.full((len(windows), width), -1, np.int32)
    for k, w in enumerate(windows):
        table[k, : len(w)] = w
    items, n_terms = [sorted(x) for x in block.items], len(block.vocabulary)
    out = pa.schema([("segment", pa.string()), ("base", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def lookup(part: pa.Table) -> pa.Table:
        term = part["term"].to_numpy()
        bases = np.sort(part["base"].to_numpy()[term < 0].astype(np.int64))
        lists = {int(t): np.frombuffer(p, "<i8") for t, p in zip(term, part["positions"].to_pylist()) if t >= 0}
        present = np.zeros(n_terms + 1, bool)
        present[list(lists)] = True
        present[-1] = True  # the filling of short windows
        starts, ends, which = [], [], []
        for k in np.flatnonzero(present[table].all(axis=1)):
            w = windows[k]
            at, n = (proximity(lists, w, slop), len(w) + slop) if slop else (exact(lists, w), len(w))
            starts.append(at)
            ends.append(at + n)
            which.append(np.full(len(at), k))
        rows: list[tuple] = []
        if starts and sum(map(len, starts)):
            s, e, k = map(np.concatenate, (starts, ends, which))
            doc = np.searchsorted(bases, np.maximum(s, 0), "right") - 1
            order = np.lexsort((s, doc))
            s, e, k, doc = s[order], e[order], k[order], doc[order]
            for part_of in np.split(np.arange(len(s)), np.flatnonzero(np.diff(doc)) + 1):
                base, spans = int(bases[doc[part_of[0]]]), []
                for a, z in zip(np.maximum(s[part_of] - base, 0).tolist(), (e[part_of] - base).tolist()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(z, spans[-1][1])
                    else:
                        spans.append([a, z])
                found = sorted({x for j in np.unique(k[part_of]) for x in items[j]})
                rows.append((base, sum(z - a for a, z in spans), spans, found))
        segment = part["segment"][0].as_py()
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.table([pa.array([segment] * len(rows), pa.string()), *(pa.array(list(c), f.type) for c, f in zip(cols, list(out)[1:]))], schema=out)

    schema = "segment string, base long, n_hit long, spans array<array<long>>, items array<string>"
    return index.select("segment", "term", "positions", "base").groupBy("segment").applyInArrow(lookup, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, spans, items): each document's hit words and the items whose windows occur in it.

    A document row with a null text has no words; each row yields one row, whatever
    its id. Items with a null text or without words have no windows; a null item id
    is listed as ``null``. Spans may overlap if the benchmark has several blocks,
    whose hits are put together by id and text. Other columns are ignored.
    """
    docs_of, hits_of = [], []
    for block in blocks(benchmark, size, block_words=block_words):
        index = build_index(docs, block, slop, id_col, text_col)
        docs_of.append(index.where("term = -1").select("segment", "base", "id", "n_words", "key"))
        hits_of.append(search(index, block, slop))
    if not docs_of:  # no window at all
        none = build_index(docs, Block(), slop, id_col, text_col).where("term = -1")
        return none.select("id", "n_words", F.lit(None).cast("array<array<long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    if len(docs_of) == 1:
        return docs_of[0].join(hits_of[0], ["segment", "base"], "left").select("id", "n_words", "spans", "items")
    parts = [d.join(h, ["segment", "base"]).select(F.struct("id", "key").alias("doc"), "spans", "items") for d, h in zip(docs_of, hits_of)]
    hits = functools.reduce(DataFrame.unionByName, parts).groupBy("doc")
    hits = hits.agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    mine = docs_of[0].select("id", "n_words", F.struct("id", "key").alias("own"))
    return mine.join(hits, F.col("own").eqNullSafe(F.col("doc")), "left").select("id", "n_words", "spans", "items")


def _digest(found: DataFrame) -> DataFrame:
    spans = F.array_sort(F.coalesce("spans", F.array().cast("array<array<long>>")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last"))

    def add(a: F.Column, s: F.Column) -> F.Column:
        end = F.least(s[1], F.col("n_words"))
        more = F.greatest(end - F.greatest(s[0], a["last"]), F.lit(0))
        return F.struct((a["n"] + more).alias("n"), F.greatest(a["last"], end).alias("last"))

    hit = F.aggregate(spans, zero, add, lambda a: a["n"])
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select("id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"))


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return _digest(contamination(docs, benchmark)).select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` in which no window of the benchmark occurs."""
    rows = docs.select(F.struct(*docs.columns).alias("row__"), "text")
    found = contamination(rows, benchmark, id_col="row__")
    return found.where(F.coalesce(F.size("items"), F.lit(0)) <= 0).select("id.*")


OP4_SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), d AS (
  SELECT doc_id, r, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), i AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows), runs AS (
  SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)
), hits AS (SELECT r, k, runs.n, item FROM runs JOIN windows USING (n, s)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

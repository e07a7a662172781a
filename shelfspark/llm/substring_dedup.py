"""Removal of every passage that occurs more than once, with a count-min prefilter.

A window is so many consecutive words of a document. Each window selects one strip of
words in it (the least by hash, leftmost of equals), so equal windows select equal
strips at equal offsets, and different windows that select one strip share its place.
Tasks count the strips they meet in a count-min sketch of two rows; the tasks' sketches
are merged by blocks. A strip's estimate is at least the number of its places, and so at
least that of any window that selects it: a window whose estimate is one is certainly
unique and goes no further.

The second pass groups all others exactly, by hashes of all their words (128 bits in
all). Windows that select one strip travel as one row, dealt by the strip. Since an
estimate is an upper bound, a strip estimated below ``HOT`` has fewer rows than that, so
no task meets a large group. Windows of hotter strips are counted with partial sums, one row
for each chunk of texts; those that repeat are few for what they cover, so up to
``MOST_HOT`` of them are sent to the tasks that cut the texts, which look their windows up;
more are joined to their places.

The sketch grows with the texts. Up to ``MOST_SLOTS`` slots (two bit maps of 16 MB) it
is sent to the tasks; beyond that it stays a table, and the strips are sent to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.storage import bounded_batches, stored

WINDOW = 35
#: Characters of text for each slot of the sketch, and the most slots that are broadcast.
CHARS_A_SLOT, MOST_SLOTS = 8, 1 << 27
#: Counters stop here; strips estimated so high are grouped by counts and a join.
HOT = 2_000
#: Repeated windows of hot strips that are broadcast at most, 12 bytes each.
MOST_HOT = 1_000_000
BLOCKS = 512
#: Words worked on at once; a longer document is worked on by itself.
CHUNK = 250_000
#: Words whose hashes a task remembers.
REMEMBERED = 200_000
#: low bits of an ordered hash that hold its position
PLACE = (1 << 28) - 1
# Odd multipliers of the rolling hashes and of the mixing step.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def _rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of each ``size`` neighbours."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.full(len(h), base, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)))
    back = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    return (total[size:] - total[:-size]) * np.cumprod(back, dtype=np.uint64)


class Chunk:
    """Some documents' words one after another: the windows that lie in one document, and the strips they select."""

    def __init__(self, rows: list[int], sizes: list[int], hashes: np.ndarray, window: int):
        self.rows = np.array(rows)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        valid = np.ones(len(hashes), bool)
        for k in range(min(window - 1, int(max(sizes, default=0)))):
            valid[(ends - 1 - k)[np.array(sizes) > k]] = False
        self.at = np.flatnonzero(valid)
        self.row = np.repeat(np.arange(len(rows)), sizes)[self.at]
        self.pos = self.at - starts[self.row] if len(self.at) else self.at
        self.hashes, self.window = hashes, window
        wide = 1 << max(0, (window // 2).bit_length() - 1)
        strip = _mix(_rolling(hashes, window - wide + 1, BASES[0]), MIX[0])
        least = (strip & np.uint64(~PLACE & (1 << 64) - 1)) | np.arange(len(strip), dtype=np.uint64)
        have = 1
        while have < wide:
            least = np.minimum(least[:-have], least[have:]) if len(least) > have else least[:0]
            have *= 2
        selected = (least[self.at] & np.uint64(PLACE)).astype(np.int64) if len(self.at) else np.zeros(0, np.int64)
        new = np.ones(len(selected), bool)
        new[1:] = selected[1:] != selected[:-1]
        self.first = np.flatnonzero(new)  # the first window of each selected strip
        self.which = np.cumsum(new) - 1
        self.place = selected[self.first]
        self.strip = strip[self.place]
        self.strip_size = window - wide + 1

    def second(self, size: int, at: np.ndarray) -> np.ndarray:
        """Another hash, of 32 bits, of ``size`` words at these places, as a signed number."""
        two = _rolling(_mix(self.hashes, MIX[1]), size, BASES[1])[at]
        return (two >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def keys(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of these windows, as signed numbers."""
        return self.first_hash(of).view(np.int64), self.second(self.window, self.at[of])

    def first_hash(self, of: np.ndarray) -> np.ndarray:
        """A 64-bit hash of these windows (indexes of ``at``)."""
        return _mix(_rolling(self.hashes, self.window, BASES[0])[self.at[of]], MIX[0])


def chunks(texts: pa.Array, window: int, seen: _Hashes) -> Iterator[Chunk]:
    """Texts in UTF-8; null is empty."""
    rows, sizes, words = [], [], []
    for i, x in enumerate(texts):
        mine = x.as_py().split() if x.is_valid else []
        if len(mine) >= window:
            rows.append(i)
            sizes.append(len(mine))
            words += mine
        if words and (len(words) >= CHUNK or i + 1 == len(texts)):
            yield Chunk(rows, sizes, np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)), window)
            rows, sizes, words = [], [], []
    if words:
        yield Chunk(rows, sizes, np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)), window)


def _slots(strip: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """A place in each of the sketch's two rows, which are half the slots each."""
    shift = np.uint64(64 - (slots // 2).bit_length() + 1)
    return (_mix(strip, MIX[1]) >> shift).astype(np.int64), (_mix(strip ^ np.uint64(BASES[1]), MIX[0]) >> shift).astype(np.int64) + slots // 2


def sketch(rows: DataFrame, slots: int, window: int) -> DataFrame:
    """(block, again, hot): for each block of slots the merged sketch, a bit for each slot counted twice or more, and HOT times or more."""
    wide = slots // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Hashes()
        for b in batches:
            for c in chunks(b.column(1), window, seen):
                slot, n = np.unique(np.concatenate(_slots(c.strip, slots)), return_counts=True)
                blocks, at = np.unique(slot // wide, return_index=True)
                lists = [[part.tobytes() for part in np.split(x, at[1:])] if len(blocks) else [] for x in ((slot % wide).astype("<u4"), np.minimum(n, HOT).astype("<u2"))]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *(pa.array(x, pa.binary()) for x in lists)], ["block", "places", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, np.ndarray] = {}
        for b in batches:
            for block, places, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                mine = counters.setdefault(block, np.zeros(wide, np.uint16))
                at = np.frombuffer(places.as_py(), "<u4")  # places of one list differ
                mine[at] = np.minimum(mine[at] + np.frombuffer(counts.as_py(), "<u2"), HOT)
        for block, mine in counters.items():
            maps = [pa.array([np.packbits(mine >= k, bitorder="little").tobytes()], pa.binary()) for k in (2, HOT)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *maps], ["block", "again", "hot"])

    return rows.mapInArrow(count, "block int, places binary, counts binary").repartition("block").mapInArrow(merge, "block int, again binary, hot binary")


class _Estimates:
    """For each strip of a chunk 0 (once), 1 (again) or 2 (hot): by the sketch, or by the lists that came with the rows."""

    def __init__(self, maps: tuple[bytes, bytes] | None, slots: int):
        self.maps = [np.frombuffer(m, np.uint8) for m in maps] if maps else None
        self.slots = slots

    def of(self, c: Chunk, b: pa.RecordBatch) -> np.ndarray:
        levels = np.zeros(len(c.strip), np.int8)
        for k in (0, 1):
            if self.maps:
                reached = np.ones(len(c.strip), bool)
                for slot in _slots(c.strip, self.slots):
                    reached &= (self.maps[k][slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
            else:
                lists = [np.array(b.column(2 + k)[int(r)].as_py() or (), np.int64) + (n << 40) for n, r in enumerate(c.rows)]
                reached = np.isin((c.row[c.first] << 40) + c.pos[c.first], np.concatenate(lists) if lists else np.zeros(0, np.int64))
            levels += reached
        return levels


STRETCH = "fp1 long, fp2 int, num long, pos int, off int, checks binary"


def _stretches(rows: DataFrame, estimates: Callable[[], _Estimates], window: int) -> DataFrame:
    """(fp1, fp2, num, pos, off, checks): windows from word pos on that select one strip, ``off`` words behind the first; a 32-bit hash of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = _Hashes(), estimates()
        for b in batches:
            nums = b.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(b.column(1), window, seen):
                light = known.of(c, b) == 1
                first = c.first[light]
                of = np.flatnonzero(light[c.which])
                ends = np.cumsum(np.diff(np.append(c.first, len(c.at)))[light])
                binary = _packed((c.first_hash(of) >> np.uint64(32)).astype("<u4"), ends)
                place = c.place[light]
                arrays = [c.strip[light].view(np.int64), c.second(c.strip_size, place), nums[c.rows[c.row[first]]], c.pos[first].astype(np.int32), (place - c.at[first]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in arrays), binary], ["fp1", "fp2", "num", "pos", "off", "checks"])

    return rows.mapInArrow(run, STRETCH)


def _met(stretches: DataFrame) -> DataFrame:
    """(num, pos, n): runs of windows that equal another one of the same strip."""

    def repeats(t: pa.Table) -> pa.RecordBatch:
        fp1, fp2, num, pos, off = (t.column(k).to_numpy() for k in range(5))
        size = np.array([len(x) // 4 for x in t.column(5).to_pylist()], np.int64)
        check = np.frombuffer(b"".join(t.column(5).to_pylist()), "<u4").astype(np.uint64)
        new = np.ones(len(fp1), bool)
        new[1:] = (fp1[1:] != fp1[:-1]) | (fp2[1:] != fp2[:-1])
        row = np.repeat(np.arange(len(fp1)), size)
        within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        key = (np.cumsum(new)[row].astype(np.uint64) << np.uint64(38)) | ((off[row] - within).astype(np.uint64) << np.uint64(32)) | check
        _, which, n = np.unique(key, return_inverse=True, return_counts=True)
        again = n[which] > 1
        starts = again & ~np.concatenate(([False], again[:-1] & (row[1:] == row[:-1])))
        run = np.cumsum(starts)[again]
        at = np.flatnonzero(starts)
        arrays = [num[row[at]], (pos[row[at]] + within[at]).astype(np.int32), np.bincount(run, minlength=len(at) + 1)[1:].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["num", "pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the last strip met, fewer than HOT
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            fp1, fp2 = held.column(0).to_numpy(), held.column(1).to_numpy()
            last = np.flatnonzero((fp1 != fp1[-1:]) | (fp2 != fp2[-1:]))
            if len(last):
                yield repeats(held.slice(0, int(last[-1]) + 1))
                held = held.slice(int(last[-1]) + 1)
        if held is not None and held.num_rows:
            yield repeats(held)

    dealt = stretches.repartition("fp1").sortWithinPartitions("fp1", "fp2")
    return dealt.mapInArrow(run, "num long, pos int, n int")


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of the runs of an array that end there."""
    offsets = (np.concatenate(([0], ends)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _placed(rows: DataFrame, estimates: Callable[[], _Estimates], window: int, places: bool) -> DataFrame:
    """(h1, h2, n): the windows of hot strips, each once for a chunk of texts; with ``places`` also where, as (nums, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = _Hashes(), estimates()
        for b in batches:
            nums = b.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(b.column(1), window, seen):
                of = np.flatnonzero((known.of(c, b) == 2)[c.which])
                h1, h2 = c.keys(of)
                order = np.lexsort((h2, h1))
                h1, h2, of = h1[order], h2[order], of[order]
                last = np.flatnonzero(np.append((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]), len(h1) > 0)[: len(h1)])
                arrays = [pa.array(h1[last]), pa.array(h2[last]), pa.array(np.diff(last, prepend=-1).astype(np.int32))]
                if places:
                    arrays += [_packed(nums[c.rows[c.row[of]]].astype("<i8"), last + 1), _packed(c.pos[of].astype("<i4"), last + 1)]
                yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "n", "nums", "places"][: len(arrays)])

    return rows.mapInArrow(run, "h1 long, h2 int, n int" + (", nums binary, places binary" if places else ""))


def _hot_set(rows: DataFrame, estimates: Callable[[], _Estimates], window: int) -> DataFrame:
    """(h1, h2): windows of hot strips that occur more than once."""
    found = _placed(rows, estimates, window, False).groupBy("h1", "h2").agg(F.sum("n").alias("all")).where("all > 1")
    return stored(found.select("h1", "h2"), "substring-hot")


def _hot_places(rows: DataFrame, estimates: Callable[[], _Estimates], window: int, hot: DataFrame) -> DataFrame:
    """(num, pos, n): where the windows ``hot`` are, for sets that are too large to send to the tasks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            num, pos = (np.frombuffer(b"".join(b.column(k).to_pylist()), t) for k, t in ((0, "<i8"), (1, "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(num), pa.array(pos), pa.array(np.ones(len(num), np.int32))], ["num", "pos", "n"])

    placed = _placed(rows, estimates, window, True)
    return placed.join(hot, ["h1", "h2"]).select("nums", "places").mapInArrow(unpack, "num long, pos int, n int")


class _Members:
    """A sorted set of windows."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        order = np.lexsort((h2, h1))
        self.h1, self.h2 = h1[order], h2[order]
        starts = np.flatnonzero(np.diff(self.h1, prepend=self.h1[:1] - 1)) if len(h1) else np.zeros(0, np.int64)
        self.alike = int(np.diff(np.append(starts, len(self.h1))).max(initial=0))  # of one first hash, nearly always 1

    def hold(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.h1, h1)
        out = np.zeros(len(h1), bool)
        for k in range(self.alike):
            near = np.minimum(at + k, len(self.h1) - 1)
            out |= (self.h1[near] == h1) & (self.h2[near] == h2)
        return out


def _members(hot: DataFrame) -> _Members:
    """``hot`` on the driver: MOST_HOT windows at most, 12 bytes each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [pa.array([c.to_numpy().astype(t).tobytes()], pa.binary()) for c, t in zip(b.columns, ("<i8", "<i4"))]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2"])

    found = hot.mapInArrow(pack, "h1 binary, h2 binary").collect()
    return _Members(*(np.frombuffer(b"".join(bytes(r[k]) for r in found), t) for k, t in ((0, "<i8"), (1, "<i4"))))


def _asked(rows: DataFrame, slots: int, window: int) -> DataFrame:
    """``rows`` with the first windows of strips met again and of hot ones, by strips sent to a sketch of one row that is a table of slots."""
    shift = 64 - slots.bit_length() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Hashes()
        for b in batches:
            nums = b.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(b.column(1), window, seen):
                slot = (_mix(c.strip, MIX[1]) >> np.uint64(shift)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(nums[c.rows[c.row[c.first]]]), pa.array(c.pos[c.first].astype(np.int32))], ["slot", "own", "pos"])

    strips = stored(rows.mapInArrow(run, "slot long, own long, pos int"), "substring-strips")
    again = strips.groupBy("slot", F.col("slot").bitwiseAND(F.lit(1)).alias("odd")).count().where("count > 1").select("slot", (F.col("count") >= HOT).alias("hot"))
    lists = strips.join(again, "slot").groupBy("own").agg(F.collect_list("pos").alias("again"), F.collect_list(F.when(F.col("hot"), F.col("pos"))).alias("hot"))
    return stored(rows.join(lists, F.col("num") == F.col("own")).select("num", "text", "again", "hot"), "substring-asked")


def repeated(rows: DataFrame, window: int = WINDOW, most_slots: int = MOST_SLOTS, most_hot: int = MOST_HOT) -> tuple[DataFrame, _Members]:
    """Runs (num, pos, n) of windows of ``rows(num long, text binary)`` whose words also start elsewhere, and more such windows by their hashes.

    ``num`` tells rows apart.
    """
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    slots = max(1 << 16, 1 << (chars // CHARS_A_SLOT).bit_length())
    if slots <= most_slots:
        again, hot = bytearray(slots // 8), bytearray(slots // 8)
        wide = slots // BLOCKS // 8
        for r in sketch(rows, slots, window).collect():  # two bits for each slot, 32 MB at most
            again[r.block * wide : (r.block + 1) * wide] = r.again
            hot[r.block * wide : (r.block + 1) * wide] = r.hot
        shared, any_hot = rows.sparkSession.sparkContext.broadcast((bytes(again), bytes(hot))), any(hot)
        estimates = lambda: _Estimates(shared.value, slots)
    else:
        rows, any_hot = _asked(rows, slots, window), True
        estimates = lambda: _Estimates(None, slots)
    found = _met(_stretches(rows, estimates, window))
    none = _Members(np.zeros(0, np.int64), np.zeros(0, np.int32))
    if not any_hot:
        return found, none
    hot = _hot_set(rows, estimates, window)
    if hot.count() <= most_hot:
        return found, _members(hot)
    return found.unionByName(_hot_places(rows, estimates, window, hot)), none


def _numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and the column that tells its rows apart: whole-number ids that differ, or numbers given here."""
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        most, nulls = docs.groupBy(id_col).agg(F.count("*").alias("n")).agg(F.max("n"), F.count(F.when(F.col(id_col).isNull(), 1))).first()
        if (most or 1) == 1 and not nulls:
            return docs, id_col
    return stored(docs.withColumn("num__", F.monotonically_increasing_id()), "substring-rows"), "num__"


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", most_slots: int = MOST_SLOTS, most_hot: int = MOST_HOT) -> DataFrame:
    """``docs`` without the words of any window that occurs again, the first occurrence included.

    Three more columns: ``n_words__``, ``n_removed__`` and ``kept_sha256__`` (digest of the
    kept words joined by one space). A text that loses words becomes its kept words joined
    by one space; others stay to the last blank, and null stays null. Each row is a document,
    whatever its id (null, repeated, a string). Words are runs of other than ASCII white space.
    A document shorter than a window loses nothing; an empty table gives an empty result;
    other columns are passed on. Input columns named like the new ones or ``num__``, ``own__``,
    ``starts__`` are refused.
    """
    new = ["n_words__", "n_removed__", "kept_sha256__"]
    clash = {*new, "num__", "own__", "starts__"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns in use: {sorted(clash)}")
    bounded_batches(docs.sparkSession, 1_000)
    rows, num = _numbered(docs, id_col)
    found, members = repeated(rows.select(F.col(num).cast("long").alias("num"), F.col(text_col).cast("binary").alias("text")), window, most_slots, most_hot)
    hot = docs.sparkSession.sparkContext.broadcast(members)
    starts = found.groupBy(F.col("num").alias("own__")).agg(F.collect_list(F.struct("pos", "n")).alias("starts__"))
    joined = rows.join(starts, F.col(num).cast("long") == F.col("own__"), "left").select(*(F.col(f"`{c}`").cast("binary").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), "starts__")
    names, place = docs.columns, docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = _Hashes(), hot.value
        for b in batches:
            more: dict[int, np.ndarray] = {}
            for c in chunks(b.column(place), window, seen) if len(known.h1) else ():
                of = np.flatnonzero(known.hold(*c.keys(np.arange(len(c.at)))))
                mine, first = np.unique(c.rows[c.row[of]], return_index=True)
                more |= dict(zip(mine.tolist(), np.split(c.pos[of], first[1:])))
            out: list[tuple] = []
            for i, (x, s) in enumerate(zip(b.column(place), b.column(len(names)))):
                text = x.as_py()
                words = text.split() if text is not None else []
                if s.is_valid or i in more:
                    edge = np.zeros(len(words) + 1, np.int32)
                    if s.is_valid:
                        at, n = (s.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                        np.add.at(edge, at, 1)
                        np.subtract.at(edge, at + n + (window - 1), 1)
                    if i in more:  # windows that start at different words
                        edge[more[i]] += 1
                        edge[more[i] + window] -= 1
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    whole = b" ".join(kept)
                    out.append((whole, len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest()))
                else:
                    out.append((text, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()))
            texts, n, gone, digest = zip(*out) if out else [()] * 4
            columns = [pa.array(texts, pa.binary()) if k == place else c for k, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], [*names, *new])

    fields = [T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in docs.schema]
    schema = T.StructType([*fields, T.StructField(new[0], T.LongType()), T.StructField(new[1], T.LongType()), T.StructField(new[2], T.StringType())])
    return joined.mapInArrow(cut, schema).withColumn(text_col, F.col(f"`{text_col}`").cast("string"))


def op13(docs: DataFrame) -> DataFrame:
    rows = dedup_substrings(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.col("n_words__").alias("n_words"), F.col("n_removed__").alias("n_removed"), F.col("kept_sha256__").alias("kept_sha256"))


# Every window by its words; ids of the table are distinct and not null.
OP13_SQL = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS words FROM documents
), windows AS (
  SELECT doc_id, s, sha256(array_to_string(words[s + 1:s + {WINDOW}], ' ')) AS w FROM (SELECT doc_id, words, unnest(range(0, len(words) - {WINDOW - 1})) AS s FROM docs)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS pos FROM (SELECT * FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM docs) ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

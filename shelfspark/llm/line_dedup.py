"""Removal of passages that repeat, by winnowing over line hashes.

Texts are laid out in lines of different widths, and a passage may begin inside one,
so the lines hashed here are strips of consecutive words, one from every word on.
A run of ``min_words`` words is a window. Each window selects the position of its
least hash: equal windows select equal strips, so their fingerprints are sure to
meet. Neighbouring windows mostly select the same position; such a stretch of
windows is one row (fingerprint, hash of the stretch, place).

Positions are joined on the fingerprint. Where all stretches of a fingerprint are
equal, the first stays and the others are repeats as a whole. Where they differ, a
repeat begins or ends inside them: equal ones are settled alike, and of the distinct
ones each window is compared by itself, word after word, which extends the match in
both directions exactly as far as it goes. Repeats overlap; merged they are deleted.

A word is deleted exactly if some window that holds it equals one that begins at an
earlier place, by (document, word). Words are compared by 64-bit hashes of whole
windows, among windows of equal 64-bit fingerprints. Everything is expressed with
DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.storage import stored

MIN_WORDS = 50
#: what parts words
SPACE = " \t\n\x0b\f\r"
#: so many words are addressed by one number; a longer text has several
SLOT = 24
#: low bits of an ordered hash that hold its position
PLACE = 28


def _let(x: F.Column, f: Callable[[F.Column], F.Column]) -> F.Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _words(text: str | F.Column) -> F.Column:
    return F.split(F.trim(text, F.lit(SPACE)), f"[{SPACE}]+")


def _least(order: F.Column, wide: int, then: Callable[[F.Column], F.Column], have: int = 1) -> F.Column:
    """then(the least of each ``wide`` neighbours): runs of twice the length from two that adjoin."""
    if have == wide:
        return then(order)
    by = min(have, wide - have)
    shifted = F.slice(order, by + 1, F.greatest(F.size(order) - by, F.lit(0)))
    return _let(F.zip_with(order, shifted, lambda x, y: F.least(x, y)), lambda m: _least(m, wide, then, have + by))


def _stretches(rows: DataFrame, min_words: int) -> DataFrame:
    """(fp, g, num, s, k, most) of (num, text).

    k windows from word s on select one position; the strip there hashes to fp, all
    their words to g. Stretches that follow and equal it (as in text of one word) are
    left out: up to the next other stretch there are ``most`` windows.
    """
    wide = 1 << max(1, 2 * min_words // 3).bit_length() - 1  # a power of two takes the fewest steps
    strip = min_words - wide + 1
    low = (1 << PLACE) - 1

    position = lambda x: x.bitwiseAND(F.lit(low)).cast("int")

    def cut(words: F.Column, least: F.Column) -> F.Column:
        n = F.size(words) - (min_words - 1)

        def start(chosen: F.Column, x: F.Column, j: F.Column) -> F.Column:
            """The first window of a selection: a lesser hash comes in at the end, or the one before goes out."""
            before = F.get(chosen, j - 1)
            return F.when(j == 0, 0).when(x < before, position(x) - (wide - 1)).otherwise(position(before) + 1)

        def stretch(x: F.Column, s: F.Column, k: F.Column) -> F.Column:
            fp = F.xxhash64(F.slice(words, position(x) + 1, strip))
            return F.struct(fp.alias("fp"), F.xxhash64(F.slice(words, s + 1, k + (min_words - 1))).alias("g"), s.alias("s"), k.alias("k"))

        def differs(x: F.Column, before: F.Column) -> F.Column:
            return (x["fp"] != before["fp"]) | (x["g"] != before["g"])

        def ends(z: F.Column) -> F.Column:
            return F.transform(z, lambda x, j: F.struct(*(x[c].alias(c) for c in ("fp", "g", "s", "k")), (F.coalesce(F.get(z, j + 1)["s"], n) - x["s"]).alias("most")))

        def stretches(chosen: F.Column) -> F.Column:
            starts = F.transform(chosen, lambda x, j: start(chosen, x, j))
            return _let(starts, lambda b: F.transform(chosen, lambda x, j: stretch(x, F.get(b, j), F.coalesce(F.get(b, j + 1), n) - F.get(b, j))))

        others = lambda z: F.filter(z, lambda x, j: (j == 0) | differs(x, F.get(z, j - 1)))
        chosen = F.array_distinct(F.slice(least, 1, F.greatest(n, F.lit(0))))
        return _let(_let(_let(chosen, stretches), others), ends)

    def winnow(words: F.Column) -> F.Column:
        order = F.transform(words, lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        return _let(order, lambda v: _least(v, wide, lambda m: cut(words, m)))

    long_enough = rows.where(F.length("text") >= 2 * min_words - 1)  # others have fewer words
    return long_enough.select("num", F.explode(_let(_words("text"), winnow)).alias("x")).select("x.fp", "x.g", "num", "x.s", "x.k", "x.most")


def _first(rows: DataFrame, *keys: str, more: tuple[F.Column, ...] = ()) -> DataFrame:
    """The first and last place of each key.

    Grouped by one more expression of the key, so that a join on the key shuffles this
    small side by itself and Spark may split a hot key's rows on the other side.
    """
    at = _place()
    return rows.groupBy(*keys, F.col(keys[-1]).bitwiseAND(F.lit(1)).alias("odd")).agg(F.min(at).alias("first"), F.max(at).alias("last"), *more).drop("odd")


def _place() -> F.Column:
    return F.shiftleft("num", SLOT) + F.col("s")


def repeated_runs(docs: DataFrame, num: F.Column, text_col: str, min_words: int) -> DataFrame:
    """(num, runs): for documents with repeats, the merged ranges (start, end) of repeated words."""
    rows = docs.select(num.alias("num"), F.col(text_col).alias("text"))
    found = stored(_stretches(rows, min_words), "line-stretches")
    other = (F.min("g").alias("lo"), F.max("g").alias("hi"))
    shared = _first(found, "fp", more=other).where("first < last").select("fp", "first", (F.col("lo") != F.col("hi")).alias("mixed"))
    met = stored(found.join(shared, "fp"), "line-met")
    span = lambda start, end: ("num", start.alias("start"), (end + (min_words - 1)).alias("end"))
    s, k, most = F.col("s"), F.col("k"), F.col("most")
    repeats = [found.where(most > k).select(*span(s + k, s + most - 1))]
    repeats += [met.where(~F.col("mixed") & (_place() != F.col("first"))).select(*span(s, s + k - 1))]
    mixed = met.where("mixed").select("fp", "g", "num", "s", "k")
    mixed = stored(mixed.join(_first(mixed, "fp", "g"), ["fp", "g"]), "line-mixed")
    repeats += [mixed.where(_place() != F.col("first")).select(*span(s, s + k - 1))]
    # the windows of distinct stretches of one fingerprint, each by itself
    lists = mixed.where(_place() == F.col("first")).groupBy("num").agg(F.collect_list(F.struct("s", "k", "fp")).alias("open"))
    lists = lists.withColumnRenamed("num", "own")
    texts = docs.select(*docs.columns).join(lists, num == F.col("own")).select("own", F.col(text_col).alias("text"), "open")

    def windows(words: F.Column) -> F.Column:
        one = lambda i, fp: F.struct(i.alias("s"), F.xxhash64(F.slice(words, i + 1, min_words), fp).alias("w"))
        return F.flatten(F.transform("open", lambda x: F.transform(F.sequence(x["s"], x["s"] + x["k"] - 1), lambda i: one(i, x["fp"]))))

    seen = texts.select(F.col("own").alias("num"), F.explode(_let(_words("text"), windows)).alias("x")).select("num", "x.s", "x.w")
    again = _first(seen, "w").where("first < last").select("w", "first")
    repeats += [seen.join(again, "w").where(_place() != F.col("first")).select(*span(s, s))]
    every = repeats[0]
    for r in repeats[1:]:
        every = every.unionByName(r)
    doc = W.partitionBy("num").orderBy("start", "end")
    reach = F.max("end").over(doc.rowsBetween(W.unboundedPreceding, -1))
    every = every.withColumn("new", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int"))
    every = every.withColumn("run", F.sum("new").over(doc.rowsBetween(W.unboundedPreceding, 0)))
    runs = every.groupBy("num", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("num").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, F.Column]:
    """``docs``, perhaps with another column, and each document's number: in the order of ids, with a slot for each 2 ** 24 words.

    Distinct whole-number ids serve as they are. Others (strings, nulls, repeated ids,
    very long texts) are numbered: by id, null first, then by the text's hash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    long_text = F.max(F.length(text_col)).alias("l")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        seen = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"), long_text)
        n, longest, lo, hi, nulls = seen.agg(F.max("n"), F.max("l"), F.min("id"), F.max("id"), F.sum(F.col("id").isNull().cast("int"))).first()
        if n is None or (n == 1 and not nulls and (longest or 0) < 1 << SLOT + 1 and hi - lo < 1 << 62 - SLOT):
            return docs, F.coalesce(F.col(id_col).cast("long") - F.lit(lo or 0).cast("long"), F.lit(0).cast("long"))
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    found = docs.groupBy(own.alias("own")).agg(long_text).select("own.id", "own.h", (1 + F.shiftright(F.coalesce("l", F.lit(0)).cast("long"), SLOT + 1)).alias("slots"))
    dealt = stored(found.repartitionByRange("id", "h").withColumn("part", F.spark_partition_id()), "line-numbers")
    within = W.partitionBy("part").orderBy("id", "h").rowsBetween(W.unboundedPreceding, 0)
    parts = dealt.groupBy("part").agg(F.sum("slots").alias("n"))  # one row for each partition
    base = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    numbers = dealt.withColumn("up", F.sum("slots").over(within) - F.col("slots")).join(F.broadcast(parts.select("part", base.alias("base"))), "part")
    numbers = numbers.select(F.struct("id", "h").alias("own__"), (F.col("base") + F.col("up")).alias("num__"))
    joined = docs.join(numbers, own.eqNullSafe(F.col("own__")), "left").drop("own__")
    return stored(joined, "line-numbered"), F.coalesce("num__", F.lit(0).cast("long"))


def _cut(text: str, runs: str) -> F.Column:
    """The text without runs of words. The blanks before a run stay if they hold a newline, else those after it."""
    lead = lambda x: F.substr(x, F.lit(1), F.length(x) - F.length(F.ltrim(x, F.lit(SPACE))))

    def pieces(tokens: F.Column) -> F.Column:
        n = F.size(runs)

        def piece(j: F.Column) -> F.Column:
            before = F.get(runs, j - 1)
            a = F.when(j == 0, 0).otherwise(before["end"] + 1)
            z = F.when(j == n, F.size(tokens)).otherwise(F.get(runs, j)["start"])
            own, first = F.array_join(F.slice(tokens, a + 1, z - a), ""), F.get(tokens, before["start"])
            gap = F.when(lead(first).contains("\n"), lead(first)).otherwise(lead(own))
            gap = F.when(before["start"] == 0, "").otherwise(gap)
            return F.when(z <= a, "").when(j == 0, own).otherwise(F.concat(gap, F.ltrim(own, F.lit(SPACE))))

        end = F.when(F.element_at(runs, -1)["end"] < F.size(tokens) - 1, F.substr(F.col(text), F.length(F.rtrim(F.col(text), F.lit(SPACE))) + 1)).otherwise("")
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n), piece), ""), end)

    return _let(F.regexp_extract_all(F.col(text), F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0)), pieces)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts cleaned, and one more column ``runs__``: the deleted ranges of words, or null.

    The earliest occurrence of a passage stays, by id (null first), then text hash, then
    word. Rows with the same id and text count as one document and are cleaned alike. A
    null text stays null; texts without repeats stay as they are to the last blank; an
    empty table gives an empty result; other columns are passed on. Input columns named
    ``runs__``, ``num__`` or ``own__`` are refused.
    """
    clash = {"runs__", "num__", "own__"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns in use: {sorted(clash)}")
    rows, num = _numbered(docs, id_col, text_col)
    runs = repeated_runs(rows, num, text_col, min_words).select(F.col("num").alias("own__"), F.col("runs").alias("runs__"))
    rows = rows.join(runs, num == F.col("own__"), "left")
    cut = F.when(F.col("runs__").isNull(), F.col(text_col)).otherwise(_cut(text_col, "runs__"))
    return rows.select(*(cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), "runs__")


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, runs (start-end of deleted words) and the kept text's digest, of every document."""
    rows = dedup_lines(docs.select("doc_id", "text"))
    runs = F.coalesce("runs__", F.array().cast("array<struct<start:int,end:int>>"))
    gone = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"] + 1)
    listed = F.array_join(F.transform(runs, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return rows.select("doc_id", gone.alias("n_removed"), listed.alias("runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Pipeline stage: texts without repeated passages; documents that keep no word of a repeated text go."""
    rows = dedup_lines(docs)
    emptied = F.col("runs__").isNotNull() & (F.trim("text", F.lit(SPACE)) == "")
    return rows.where(~emptied).select(*docs.columns)


# Every window of 50 words by itself; ids of the table are distinct and not null.
OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, text, regexp_extract_all(text, '[ \t\n\v\f\r]*[^ \t\n\v\f\r]+') AS tokens,
    regexp_extract_all(text, '[^ \t\n\v\f\r]+') AS words FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(words[s + 1:s + 50], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS s FROM docs)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos
  FROM (SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1)
), islands AS (
  SELECT doc_id, min(pos) AS start, max(pos) AS stop, count(*) AS n
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g
), listed AS (
  SELECT doc_id, sum(n)::BIGINT AS n, string_agg(start || '-' || stop, ',' ORDER BY start) AS runs FROM islands GROUP BY doc_id
), split AS (
  SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM docs
), parts AS (
  SELECT doc_id, pos, token, regexp_extract(token, '^[ \t\n\v\f\r]*') AS lead, regexp_extract(token, '[^ \t\n\v\f\r]+') AS word FROM split
), kept AS (
  SELECT p.doc_id, p.pos, CASE WHEN i.start IS NULL THEN p.token WHEN i.start = 0 THEN p.word
    WHEN contains(f.lead, chr(10)) THEN f.lead || p.word ELSE p.token END AS token
  FROM parts p ANTI JOIN gone USING (doc_id, pos)
  LEFT JOIN islands i ON i.doc_id = p.doc_id AND i.stop + 1 = p.pos LEFT JOIN parts f ON f.doc_id = i.doc_id AND f.pos = i.start
), whole AS (
  SELECT doc_id, string_agg(token, '' ORDER BY pos) AS text FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(listed.n, 0)::BIGINT AS n_removed, coalesce(listed.runs, '') AS runs,
  sha256(CASE WHEN listed.n IS NULL THEN coalesce(d.text, '') WHEN gone.pos IS NULL THEN whole.text || regexp_extract(d.text, '[ \t\n\v\f\r]*$')
    ELSE coalesce(whole.text, '') END) AS text_sha256
FROM docs d LEFT JOIN listed USING (doc_id) LEFT JOIN whole USING (doc_id) LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.pos = len(tokens) - 1
"""

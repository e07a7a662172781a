"""Secrets in texts: fixed patterns, and strings that look random to a pair of Markov models.

Two first-order models over characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A run of 16 or more identifier
characters that overlaps no pattern's match is a secret if the logarithm of its
likelihood ratio, per transition and in total, is large enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.storage import bounded_batches

# The patterns and least lengths of the query's contract.
ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # a run is matched whole, so the least length can stand in the pattern
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS = 6, 20

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Least log-likelihood ratio (nats) per transition and in total.
PER_STEP, TOTAL = 0.8, 14.0
#: Ordinary identifiers are sampled from so many documents at most.
SAMPLE_DOCS = 2_000
#: Random strings generated for training.
RANDOM_STRINGS = 6_000


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """text: reproducible random hex, base-64, base-62 and upper-case strings of 16 to 40 characters."""
    rows = spark.range(n).select("id", F.sha2(F.concat(F.lit("random-"), F.col("id")), 512).alias("hex"))
    b64 = F.base64(F.unhex("hex"))
    size = (16 + F.col("id") % 25).cast("int")
    kinds = F.array(F.col("hex"), b64, F.regexp_replace(b64, "[+/=]", ""), F.translate(b64, "+/=", "-_"), F.upper(F.regexp_replace(b64, "[+/=]", "")))
    return rows.select(F.substring(F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")), F.lit(1), size).alias("text"))


# Ordinary words of identifiers, paths and hosts.
WORDS = """access account action address admin agent alert amount answer application archive array article asset async author backup
balance batch binary block branch browser bucket buffer build button bytes cache calendar callback category channel chapter
character check child class client cluster code collection column command comment common company component config connection
container content context control cookie count country create current customer data database date default delete description
design detail device directory document domain download driver editor element email engine entry error event example export
factory feature field file filter folder format frame function gateway global graph group handler header height history home
host icon image import index input install instance interface internal invoice item javascript job journal keyboard label
language layer layout length level library limit link list load local location login lookup machine manager market master
match maximum media member memory message method minimum mobile model module monitor name network node notes number object
offset option order output owner package page parent parser password path pattern payment people permission phone picture
platform player plugin point policy position power price primary private process product profile program project property
protocol provider public""".split()


def identifiers(spark: SparkSession) -> DataFrame:
    """text: compounds of ``WORDS`` as code, paths and hosts have them, with numbers, dates and version numbers."""
    n = len(WORDS)
    words = F.array(*map(F.lit, WORDS))
    rows = spark.range(12 * n).select("id", *(F.element_at(words, ((F.col("id") * k + k) % n + 1).cast("int")).alias(f"w{k}") for k in (1, 7, 11)))
    day = F.date_format(F.timestamp_seconds(F.col("id") * 7_654_321), "yyyy-MM-dd'T'HH-mm-ss")
    number = (F.col("id") * 37 % 2100).cast("string")
    shapes = [
        F.concat("w1", F.initcap("w7"), F.initcap("w11")), F.concat_ws("_", "w1", "w7", "w11", number), F.concat_ws("-", "w1", "w7", number),
        F.concat(F.lit("/"), F.concat_ws("/", "w1", "w7", "w11"), F.lit("/v"), number), F.upper(F.concat_ws("_", "w1", "w7")), day, F.concat("w1", "w7", number), F.concat(F.initcap("w1"), F.initcap("w7"), number),
    ]
    return rows.select(F.element_at(F.array(*shapes), (F.col("id") % len(shapes) + 1).cast("int")).alias("text"))


def labelled_samples(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, random): the training set of ``train``.

    Random: generated strings. Ordinary: words of letters and digits of at most
    ``sample_docs`` documents (those with the least text hashes), outside the
    matches of the patterns, and compounds of two of them as identifiers have
    them (camelCase, snake_case, kebab-case and paths), and ``identifiers``.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("at")).where("text is not null")
    least = texts.select("at").distinct().orderBy("at").limit(sample_docs).agg(F.max("at")).first()[0]
    few = texts.where(F.col("at") <= F.lit(least)).dropDuplicates(["at"])
    clean = F.regexp_replace("text", f"{ASSIGN.pattern}|{ACCESS.pattern}|{HEX.pattern}", " ")
    words = few.select(F.posexplode(F.regexp_extract_all(clean, F.lit("[A-Za-z]{3,15}[0-9]{0,2}"), 0)).alias("pos", "w"))
    joint = F.element_at(F.array(F.lit(""), F.lit("_"), F.lit("-"), F.lit("/")), (F.col("pos") % 4 + 1).cast("int"))
    ordinary = words.select(F.concat(F.col("w"), joint, F.initcap("w")).alias("text"))
    ordinary = ordinary.unionByName(identifiers(spark)).withColumn("random", F.lit(False))
    return random_strings(spark).withColumn("random", F.lit(True)).unionByName(ordinary)


def train(samples: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each transition between ``LETTERS`` (last index: any other), random over ordinary.

    Transitions are counted by grouping; at most 2 x 68 x 68 counts reach the driver.
    Add-one smoothing; without samples all ratios are zero and nothing is found.
    """
    chars = F.split("text", "")
    pairs = samples.where("text is not null and length(text) > 1").select("random", F.explode(F.arrays_zip(F.slice(chars, 1, F.length("text") - 1).alias("a"), F.slice(chars, 2, F.length("text") - 1).alias("b"))).alias("p"))
    code = {c: i for i, c in enumerate(LETTERS)}
    side = len(LETTERS) + 1
    counts = np.ones((2, side, side))
    known = F.lit(LETTERS)
    a, b = (F.when(F.instr(known, F.col(f"p.{c}")) > 0, F.col(f"p.{c}")).otherwise("") for c in "ab")
    for r in pairs.groupBy("random", a.alias("a"), b.alias("b")).count().collect():
        counts[int(r["random"]), code.get(r["a"], side - 1), code.get(r["b"], side - 1)] += r["count"]
    p = counts / counts.sum(axis=2, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def _codes() -> np.ndarray:
    table = np.full(128, len(LETTERS), np.intp)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i
    return table


CODE = _codes()


def ratio(model: np.ndarray, text: str) -> tuple[float, float]:
    """Log-likelihood ratio of an ASCII string, in total and per transition."""
    c = CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
    total = float(model[c[:-1], c[1:]].sum()) if len(c) > 1 else 0.0
    return total, total / max(len(c) - 1, 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the patterns' matches in code points."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def random_spans(text: str, model: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span and that the models call random."""
    out = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
        if mixed and not any(s < m.end() and m.start() < e for s, _, e in base):
            total, step = ratio(model, word)
            if total >= TOTAL and step >= PER_STEP:
                out.append((m.start(), 3, m.end()))
    return out


def find_secrets(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>): every secret of every whole text, by start and kind.

    One pass without a shuffle. A null or empty text has none; each row yields a
    row whatever its id; other columns are ignored; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                found = sorted(base + random_spans(text, model, base))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, spans)], names=["id", "spans"])

    schema = f"id {kind}, spans array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every document."""
    found = find_secrets(docs, train(labelled_samples(docs)))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))

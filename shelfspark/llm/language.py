"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a naive Bayes classifier over hashed
character n-grams separates the languages whose codeword has the bit from the
rest. Decoding takes the codeword of least loss over the bits' margins, weighted
by how well each bit separates the training counts. The counts come from every
training row, in one pass and one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.storage import bounded_batches, stored

#: Hashed n-gram features.
FEATURES = 1 << 14
GRAMS = (1, 2, 3)
UNKNOWN = "und"
#: Nats by which the best codeword must beat the next for an unambiguous answer.
MARGIN = 1.0
#: Nats by which it must do so for a document to stay in the pipeline, however many languages there are.
TIE = 0.04
#: Code points worked on at once, so that a long text needs little memory.
CHUNK = 1 << 18


#: Signs from U+00AA on that are no letters: first and last of ranges.
SIGNS = np.array([[0xAB, 0xB4], [0xB6, 0xB9], [0xBB, 0xBF], [0xD7, 0xD7], [0xF7, 0xF7], [0x2000, 0x206F], [0x2190, 0x27BF], [0x3000, 0x3004], [0x3008, 0x3020], [0xFF00, 0xFF20]])


def features(text: str) -> np.ndarray:
    """Counts of hashed n-grams of a whole text's words, in lower case; other characters are blanks.

    A long text is worked on in pieces. The last code points of a piece are put before
    the next, so the counts are those of the text in one piece.
    """
    counts = np.zeros(FEATURES, np.int64)
    last = np.array([32], np.uint64)
    for at in range(0, len(text) + 1, CHUNK):
        # a final sigma is the only letter whose lower case hangs on its neighbours
        part = text[at : at + CHUNK].replace("\u03a3", "\u03c3").lower() + (" " if at + CHUNK > len(text) else "")
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sign = (np.searchsorted(SIGNS[:, 0], c, "right") - np.searchsorted(SIGNS[:, 1], c, "left")) > 0
        letter = ((c >= 0xAA) & ~sign) | ((c >= 97) & (c <= 122))
        c = np.concatenate([last, np.where(letter, c, np.uint64(32))])
        new = np.append(np.ones(len(last), bool), (c[len(last) :] != 32) | (c[len(last) - 1 : -1] != 32))
        c = c[new]
        for n in GRAMS:
            if len(c) < n:
                continue
            h = np.zeros(len(c) - n + 1, np.uint64)
            blank = np.ones(len(h), bool)
            for k in range(n):
                x = c[k : k + len(h)]
                h = h * np.uint64(0x100000001B3) + x
                blank &= x == 32
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
            keep = ~blank
            keep[: max(len(last) - n + 1, 0)] = False  # n-grams of the piece before
            counts += np.bincount(h[keep].astype(np.intp), minlength=FEATURES)
        last = c[-(max(GRAMS) - 1) :]
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n codewords of 0 and 1: exhaustive for up to six, else the farthest apart of 50 seeded random codes."""
    if n <= 6:
        bits = max(2 ** (n - 1) - 1, 1)
        # column b has language 0 in the class 1 and gives the others the binary digits of b
        return np.array([[1] * bits] + [[b >> (i - 1) & 1 for b in range(bits)] for i in range(1, n)], np.int8).reshape(n, bits)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(7), (-1, None)
    for _ in range(50):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        code = code[:, (code.sum(0) > 0) & (code.sum(0) < n)]
        signs = code * 2.0 - 1
        far = (code.shape[1] - signs @ signs.T) / 2
        np.fill_diagonal(far, bits)
        if far.min() > best[0]:
            best = (far.min(), code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 and 1
    weights: np.ndarray  # features x bits, log odds of bit 1
    trust: np.ndarray  # per bit


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit the bits' classifiers to all rows with a language and a text with a letter.

    The n-gram counts per language are added up in the tasks and then by grouping,
    so the driver gets one row of ``FEATURES`` counts per language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                if has_letter(t := text.as_py()):
                    counts = features(t)
                    lang = lang.as_py()
                    if lang in sums:
                        sums[lang] += counts
                    else:
                        sums[lang] = counts
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "f", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = stored(rows.mapInArrow(run, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")), "language-counts")
    languages = [r[0] for r in sums.select("lang").distinct().orderBy("lang").collect()]
    packed = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("f", "n"))).alias("c"))

    def counts() -> Iterator[tuple[str, np.ndarray]]:
        for r in packed.toLocalIterator():  # a language at a time, FEATURES counts at most
            own = np.zeros(FEATURES)
            own[[x["f"] for x in r["c"]]] = [x["n"] for x in r["c"]]
            yield r["lang"], own

    return fit(languages, counts())


def fit(languages: list[str], counts: Iterable[tuple[str, np.ndarray]]) -> Model:
    """The model of n-gram counts by language, taken one by one in any order; every language weighs the same.

    What is held grows with the code's bits, some ten for each doubling of the languages.
    """
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 1)), np.zeros((FEATURES, 1)), np.ones(1))
    code, row, total = codewords(len(languages)), {lang: i for i, lang in enumerate(languages)}, 0.0
    one, both = np.zeros((FEATURES, code.shape[1])), np.zeros(FEATURES)
    for lang, own in counts:
        rate = own / max(own.sum(), 1)
        total += own.sum()
        both += rate
        one += np.outer(rate, code[row[lang]])
    ones = code.sum(0)
    floor = 0.5 / max(total / len(languages), 1)
    zero = np.maximum(both[:, None] - one, 0) / (len(languages) - ones) + floor
    one = one / ones + floor
    log = np.log(one) - np.log(zero)
    # mean margin per n-gram on the right side: how far the two classes' counts lie apart
    trust = ((one - zero) * log).sum(0) / 2
    return Model(languages, code * 2.0 - 1, log, trust / max(trust.mean(), 1e-12))


def decode(model: Model, counts: np.ndarray, least: float = MARGIN) -> tuple[int, float, bool]:
    """(index of the language, score, ambiguous) of a text's n-gram counts.

    A bit's margin is the log odds summed over the text's n-grams, damped since
    overlapping n-grams are not independent. The loss of a codeword is the trust-
    weighted logistic loss over its bits; scores are the softmax of the losses. The
    answer is ambiguous if the next best codeword's loss is less than ``least`` higher.
    """
    at = np.flatnonzero(counts)
    margin = counts[at] @ model.weights[at] / len(GRAMS)
    loss = (model.trust * np.logaddexp(0, -model.code * margin)).sum(1) / max(1, model.code.shape[1] / 2)
    order = np.argsort(loss, kind="stable")
    p = np.exp(loss[order[0]] - loss)
    close = len(order) > 1 and loss[order[1]] - loss[order[0]] < least
    return int(order[0]), float(1 / p.sum()), bool(close)


def identify(docs: DataFrame, model: Model, extra: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = MARGIN) -> DataFrame:
    """(id, *extra columns, lang_pred, score, ambiguous): one row per row of ``docs``.

    ``und`` with score 0 for a null text, one without a letter, or if no language
    was learned. Only the text is used. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), *(extra or []), F.col(text_col).alias("text__"))
    found = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())]
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(*f) for f in found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(b.num_columns - 1):
                text = x.as_py()
                if not model.languages or not has_letter(text):
                    out.append((UNKNOWN, 0.0, True))
                else:
                    k, score, close = decode(model, features(text), least)
                    out.append((model.languages[k], score, close))
            pred, score, close = zip(*out) if out else ((), (), ())
            arrays = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*b.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, schema)


def held_out(docs: DataFrame, id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous; learned from the rows that are not held out.

    A row with a null id is neither held out nor learned from.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(docs).alias("held_out"))
    model = learn(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identify(rows, model, ["held_out"]).withColumnRenamed("id", "doc_id")


def accepted(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose text has a recognisable language.

    Rejected are texts that are null, without a letter, or whose two best
    codewords are as good as tied (less than ``TIE`` nats apart).
    """
    known = docs.where(~held_out(docs) & F.col("doc_id").isNotNull())
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row__"))
    kept = identify(rows, learn(known), ["row__"], least=TIE)
    return kept.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("row__.*")

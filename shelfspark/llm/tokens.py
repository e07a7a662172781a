"""Tokenizing inside tasks, and token counts kept in a digest cache.

``Encoder`` returns exactly the ids of the ``tokenizers`` library. A byte-level
BPE without a normaliser encodes every pre-token by itself, so the library is
asked once for each pre-token that a worker meets and the ids are put together
again. Only texts of Latin letters and below (code points under 0x250), without
the strings of special tokens, go this way; all others go to the library whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from shelfspark.storage import bounded_batches, new_path, stored

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens of a worker's newer generation; those not met again for so many are forgotten.
REMEMBERED = 300_000
#: First code point that always goes to the library.
BEYOND = 0x250


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _charset(*kinds: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(BEYOND)) if unicodedata.category(c)[0] in kinds)


@functools.cache
def _splitter() -> re.Pattern[str]:
    """The pre-tokenizer's pattern with Unicode classes written out below ``BEYOND``."""
    letter, number = _charset("L"), _charset("N")
    space = "\t-\r \x85\xa0"  # White_Space below BEYOND
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class _Known(dict):
    """Pre-token -> its ids as bytes; what is missing comes from the older generation or the library."""

    def __init__(self, library: Tokenizer, older: dict[str, bytes]):
        self.encode, self.older = library.encode, older

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = array("I", self.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """One worker's tokenizer."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        pre = self.library.pre_tokenizer
        plain = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
        self.by_piece = plain and self.library.normalizer is None
        self.known = _Known(self.library, {})
        self.beyond = re.compile(f"[^\x00-{chr(BEYOND - 1)}]")

    def ids(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text, as unsigned 32-bit integers; a null text is empty."""
        text = text or ""
        if not self.by_piece or self.beyond.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.known) > REMEMBERED:
            self.known = _Known(self.library, dict(self.known))
        return np.frombuffer(b"".join(map(self.known.__getitem__, _splitter().findall(text))), np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


CACHE = T.StructType(
    [T.StructField("digest", T.StringType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())]
)


def token_counts(
    docs: DataFrame, vocabulary: str | None = None, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens): the library's count for each document, through a digest cache.

    ``cache`` is the path of a Parquet table (digest, version, n_tokens) that is
    made if absent and appended to; without a path a new one is made in the shared
    folder. Documents are joined to it by the SHA-256 of the content (null as the
    empty text; nothing else may be normalised, since every byte counts) and the
    tokenizer's version; only one text of each missing digest is encoded.

    Every row yields a row, whatever its id; an empty table gives an empty result.
    Two jobs that append the same digest at once do no harm: counts are reduced
    by digest when read.
    """
    spark, path = docs.sparkSession, vocabulary or vocabulary_path()
    bounded_batches(spark)
    version, where = tokenizer_version(path), cache or new_path(spark, "token-cache")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(where)  # there may be none yet
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumns({"digest": F.sha2(F.encode("text", "UTF-8"), 256), "n_bytes": F.octet_length("text").cast("long")})

    own = stored(rows.select("id", "digest", "n_bytes"), "token-digests")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.ids(x.as_py())) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=CACHE.names
            )

    def counts() -> DataFrame:
        have = spark.read.schema(CACHE).parquet(where).where(F.col("version") == version)
        return have.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    missing = rows.select("digest", "text").join(counts().select("digest"), "digest", "left_anti")
    missing = missing.groupBy("digest").agg(F.first("text").alias("text"))
    missing.mapInArrow(encode, CACHE).write.mode("append").parquet(where)
    # a table of its own, so that adaptive execution can split the documents of a hot digest in the join
    needed = stored(counts().join(own.select("digest").distinct(), "digest", "left_semi"), "token-counts")
    return own.join(needed, "digest").select("id", "n_bytes", "n_tokens")


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than 512 tokens) of every document."""
    return token_counts(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))

"""Full-text search: every word of the query, as a prefix, in some column."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import sort_key

MOST_WORDS, MOST_CHARS = 12, 64


def query_words(query: str) -> list[list[str]]:
    """The phrases a query asks for: folded tokens of its first words; words without a letter or digit are dropped."""
    clean = "".join(" " if unicodedata.category(c) == "Cc" else c for c in query)
    words = [w[:MOST_CHARS] for w in clean.split() if any(c.isalnum() for c in w)][:MOST_WORDS]
    fold = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower()
    return [re.findall(r"[^\W_]+", fold(w)) for w in words]


def matches(query: str, columns: list[str]) -> Column:
    """Whether each word (its tokens one after another, the last as a prefix) occurs in one of the columns."""
    phrases = [p for p in query_words(query) if p]
    if not phrases:
        return F.lit(False)
    patterns = [r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(map(re.escape, p)) for p in phrases]
    anywhere = lambda texts, pattern: F.exists(texts, lambda t: F.coalesce(t.rlike(pattern), F.lit(False)))
    every = lambda texts: functools.reduce(lambda x, y: x & y, [anywhere(texts, p) for p in patterns])
    # each text is folded once, whatever the number of phrases
    return F.exists(F.array(F.array(*(sort_key(F.col(c)) for c in columns))), every)

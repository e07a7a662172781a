"""A stored index for search by the beginnings of words.

The posting table has a row for each (token, row, column) with the token's positions,
ranged by token and sorted within files. The beginning of a word is a range of tokens, so
Parquet's minima and maxima let a query read only the parts that hold it; no text is read.
A very frequent token is spread over several ranges by the row's id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import sort_key
from shelfspark.operators.search import query_words
from shelfspark.storage import scratch, stored

#: Behind every token that begins with a word.
LAST = "\U0010ffff"


def tokens(text: Column) -> Column:
    """The words of a text, folded: runs of letters and digits."""
    return F.regexp_extract_all(sort_key(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(token, id, place, positions): ``place`` is the column's number, ``positions`` where the token stands in it, from 0.

    Null texts have no tokens.
    """
    return _gathered(_tokens(_words(rows, id_col, columns)))


def _words(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    each = [rows.select(F.col(id_col).alias("id"), F.lit(k).alias("place"), tokens(F.col(c).cast("string")).alias("words")) for k, c in enumerate(columns)]
    return reduce(DataFrame.unionByName, each)


def _tokens(words: DataFrame) -> DataFrame:
    return words.select("id", "place", F.posexplode("words").alias("at", "token")).select("token", "id", "place", "at")


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.groupBy("token", "id", "place").agg(F.sort_array(F.collect_list("at")).alias("positions"))


def _written(made: DataFrame, path: str) -> DataFrame:
    made.sortWithinPartitions("token", "id", "place").write.parquet(path)
    return made.sparkSession.read.schema(made.schema).parquet(path)


def build(rows: DataFrame, id_col: str, columns: list[str], path: str) -> DataFrame:
    """Write the posting table and read it back. Ids tell rows apart.

    Texts are taken apart once and their words written: finding the ranges reads these again
    and not the texts. Words are dealt into ranges and put together there, so they are shuffled
    once. Texts are dealt out first only where a small table has fewer partitions than there are cores.
    """
    rows, cores = rows.select(id_col, *columns), rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
    with scratch(rows.sparkSession):
        words = stored(_words(rows, id_col, columns), "index-words")
        return _written(_gathered(_tokens(words).repartitionByRange("token", "id", "place")), path)


def _range(index: DataFrame, token: str, prefix: bool) -> DataFrame:
    if prefix:
        return index.where((F.col("token") >= token) & (F.col("token") < token + LAST) & F.col("token").startswith(token))
    return index.where(F.col("token") == token)


def phrase_rows(index: DataFrame, phrase: list[str]) -> DataFrame:
    """(id): rows in which a phrase's tokens follow one another, the last as the beginning of one; ids may repeat."""
    if len(phrase) == 1:
        return _range(index, phrase[0], True).select("id")
    # each token votes for where the phrase would begin
    votes = [
        _range(index, t, k + 1 == len(phrase)).select("id", "place", F.explode("positions").alias("at")).select("id", "place", (F.col("at") - k).alias("begin"), F.lit(1 << k).alias("bit"))
        for k, t in enumerate(phrase)
    ]
    met = reduce(DataFrame.unionByName, votes).groupBy("id", "place", "begin").agg(F.bit_or("bit").alias("bits"))
    return met.where(F.col("bits") == (1 << len(phrase)) - 1).select("id")


def find(index: DataFrame, query: str) -> DataFrame:
    """(id): the rows that hold every word of a query, each as a beginning; none if the query has no word.

    Every word's ranges are read once and the rows they name are put together in one shuffle
    with partial sums, so a frequent word costs its postings and no more.
    """
    phrases = [p for p in query_words(query) if p]
    if not phrases:
        return index.select("id").limit(0)
    named = [phrase_rows(index, p).select("id", F.lit(1 << k).alias("bit")) for k, p in enumerate(phrases)]
    met = reduce(DataFrame.unionByName, named).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    return met.where(F.col("bits") == (1 << len(phrases)) - 1).select("id")


def suggest(index: DataFrame, beginning: str, most: int = 10) -> DataFrame:
    """(token, rows): the tokens that begin so and in how many rows, the most frequent first."""
    word = next((p[-1] for p in query_words(beginning) if p), None)
    hits = _range(index, word, True) if word else index.limit(0)
    # a row counts once, however many of its columns hold the token
    return hits.groupBy("token", "id").agg(F.lit(1).alias("one")).groupBy("token").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "token").limit(most)


def refreshed(index: DataFrame, changed: DataFrame, id_col: str, columns: list[str], path: str) -> DataFrame:
    """The index with the postings of changed rows made anew; rows that only have an id are gone from it."""
    kept = index.join(changed.select(F.col(id_col).alias("id")).distinct(), "id", "left_anti")
    with scratch(index.sparkSession):
        words = stored(_words(changed, id_col, columns), "index-words")
        made = stored(_gathered(_tokens(words)), "index-postings")
        return _written(kept.unionByName(made).repartitionByRange("token", "id", "place"), path)


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

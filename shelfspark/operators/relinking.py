"""Entries of an external collection matched to files, by steps from the surest evidence to the weakest.

Every step joins what is still open with the files on its evidence and takes only what is
clear both ways: an entry with one file, a file wanted by one entry and held by none. So a
weak step never takes what a stronger one gives. The joins are on keys of names, durations,
folders and audio; no pair of an entry and a file is made that shares none, and names, lengths
and audio that many share are met by their least and largest, not pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import music, names, text
from shelfspark.operators.linkage import alone_by_key, whole_seconds
from shelfspark.storage import stored

# How sure each kind of match is.
CONFIRMED, CONFIRMED_CHANGED, PATH, NAME_AND_LENGTH, ONLY_LENGTH, ONLY_LENGTH_DOUBTFUL = 1.0, 0.5, 1.0, 0.9, 0.8, 0.4
SAME_AUDIO, SAME_TRACK, ALIKE, DOUBTFUL, NAME = 0.95, 0.9, 0.85, 0.4, 0.5
#: A folder's candidates are looked at if they are so many at most; a larger set says nothing by a length alone.
MOST_CANDIDATES = 50
MATCH = ["entry", "file", "method", "confidence", "probable"]


def path_key(path: Column) -> Column:
    """What paths are compared by: composed letters, forward slashes, no letter case."""
    return names.upcase(text.nfc(F.replace(path, F.lit("\\"), F.lit("/"))))


def _clear(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    """(entry, file) that are alone on both sides, of files that no match holds."""
    pairs = stored(pairs.select("entry", "file").distinct(), "relink-pairs")
    entries = pairs.groupBy("entry").agg(F.count("*").alias("n")).where("n = 1").select("entry")
    files = pairs.groupBy("file").agg(F.count("*").alias("n")).where("n = 1").select("file")
    return pairs.join(entries, "entry", "left_semi").join(files, "file", "left_semi").join(taken.select("file"), "file", "left_anti")


def _untaken(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    """Pairs of files that no match holds."""
    return pairs.join(taken.select("file"), "file", "left_anti")


def relink_steps(
    entries: DataFrame, files: DataFrame, confirmed: DataFrame, rejected: DataFrame, gone: DataFrame, alike: DataFrame, most: int = MOST_CANDIDATES
) -> DataFrame:
    """(entry, file, method, confidence, probable): at most one match for each entry.

    ``entries(entry, path, title, total_s)`` (title is a key); ``files(file, path, duration_ms,
    audio, track, titles)`` are those present; ``confirmed(entry, file, audio)`` and
    ``rejected(entry, audio)`` what the user said; ``gone(path, audio, track, duration_ms)`` files
    that were at a path; ``alike(path, file)`` files whose fingerprints are duplicates of a gone one.

    1. ``user``: confirmed, doubtful if the file holds other audio now. 2. ``path``. 3.
    ``filename_duration``. 4. ``unique_duration``: the only file of that length in the folder
    the entry names and the folders its neighbours went to by steps 1 to 3. 5. ``fingerprint``:
    the audio the gone file had, then files of its track, then duplicates of it, each of about
    its length. 6. ``filename_only``: always doubtful. Steps 4 and 5 are doubtful unless a title
    of the file agrees (the same audio needs none). Files with a rejected audio are never given.
    """
    keyed = lambda df: df.withColumn("key", path_key(F.col("path"))).withColumn("name", text.file_name(F.col("key"))).withColumn("folder", text.folder_of(F.col("key")))
    entries, files = stored(keyed(entries), "relink-entries"), stored(keyed(files), "relink-files")
    gone = stored(gone.withColumn("key", path_key(F.col("path"))).select("key", "audio", "track", "duration_ms"), "relink-gone")
    empty = entries.sparkSession.createDataFrame([], "entry long, file long, method string, confidence double, probable boolean")
    now = stored(empty, "relink-found")

    def given(pairs: DataFrame, method: str, confidence: Column, probable: Column) -> DataFrame:
        """Pairs (entry, file) as matches, without those the user refused."""
        audio = pairs.join(files.select("file", F.col("audio").alias("held")), "file")
        no = rejected.select("entry", F.col("audio").alias("held")).distinct()
        return audio.join(no, ["entry", "held"], "left_anti").select("entry", "file", F.lit(method).alias("method"), confidence.alias("confidence"), probable.alias("probable"))

    def add(found: DataFrame) -> None:
        nonlocal now
        now = stored(now.unionByName(found.select(*(F.col(c).cast(now.schema[c].dataType).alias(c) for c in MATCH))), "relink-found")

    def still() -> DataFrame:
        return entries.join(now.select("entry"), "entry", "left_anti")

    sure, doubt = F.lit(False), F.lit(True)
    # what the user confirmed
    own = confirmed.select("entry", "file", F.col("audio").alias("was")).join(files.select("file", "audio"), "file").join(entries.select("entry"), "entry")
    moved = F.coalesce(F.col("was") != F.col("audio"), F.lit(False))
    add(own.select("entry", "file", F.lit("user").alias("method"), F.when(moved, CONFIRMED_CHANGED).otherwise(CONFIRMED).alias("confidence"), moved.alias("probable")))
    # the path still names a file
    one = files.groupBy("key").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n = 1").select("key", "file")
    add(still().join(one, "key").select("entry", "file", F.lit("path").alias("method"), F.lit(PATH).alias("confidence"), sure.alias("probable")))
    # the same name, and the length fits
    fits = music.duration_fits(F.col("total_s"), F.col("duration_ms"))
    timed = lambda c: F.struct(F.col(c).alias("by"), F.col("total_s").cast("long").alias("total_s")).alias("key")
    seconds = F.explode(whole_seconds(F.col("duration_ms"))).alias("total_s")
    by_name = alone_by_key(still().select("entry", timed("name")), files.select("file", "name", seconds).select("file", timed("name")))
    add(given(_untaken(by_name, now), "filename_duration", F.lit(NAME_AND_LENGTH), sure))

    # the only file of that length among the candidates of the entry's folder
    went = now.where(~F.col("probable")).join(entries.select("entry", "folder"), "entry").join(files.select("file", F.col("folder").alias("place")), "file").select("folder", "place")
    left = still().where("total_s IS NOT NULL")
    places = stored(went.unionByName(left.select("folder", F.col("folder").alias("place"))).distinct(), "relink-places")
    counts = files.groupBy(F.col("folder").alias("place")).agg(F.count("*").alias("n"))
    small = places.join(counts, "place").groupBy("folder").agg(F.sum("n").alias("n")).where(F.col("n") <= most).select("folder")
    held = places.join(small, "folder", "left_semi").join(files.select("file", F.col("folder").alias("place"), seconds), "place")
    clear = _untaken(alone_by_key(left.select("entry", timed("folder")), held.select("file", timed("folder"))), now)

    def agreed(clear: DataFrame) -> DataFrame:
        """Whether a title of the file is the entry's."""
        both = clear.join(entries.select("entry", F.col("title").alias("want")), "entry").join(files.select("file", "titles"), "file")
        return both.select("entry", "file", F.coalesce((F.col("want") != "") & F.array_contains("titles", F.col("want")), F.lit(False)).alias("agrees"))

    by_title = lambda clear, method, yes, no: given(clear, method, F.lit(0.0), sure).drop("confidence", "probable").join(agreed(clear), ["entry", "file"]).select("entry", "file", "method", F.when(F.col("agrees"), yes).otherwise(no).alias("confidence"), (~F.col("agrees")).alias("probable"))
    add(by_title(clear, "unique_duration", ONLY_LENGTH, ONLY_LENGTH_DOUBTFUL))

    # the audio of the file that was there: itself, then its track's, then what sounds like it
    was = still().select("entry", "key").join(gone.withColumnRenamed("duration_ms", "lasted"), "key")
    same = alone_by_key(was.select("entry", F.col("audio").alias("key")), files.select("file", F.col("audio").alias("key")))
    add(given(_untaken(same, now), "fingerprint", F.lit(SAME_AUDIO), sure))
    long = music.about_as_long(F.col("lasted"), F.col("duration_ms"))
    for pairs, yes in (
        (lambda w: w.where("track IS NOT NULL").join(files.select("file", "track", "duration_ms"), "track").where(long), SAME_TRACK),
        (lambda w: w.join(alike.select(path_key(F.col("path")).alias("key"), "file").distinct(), "key").join(files.select("file", "duration_ms"), "file").where(long), ALIKE),
    ):
        left = was.join(now.select("entry"), "entry", "left_anti")
        add(by_title(_clear(pairs(left), now), "fingerprint", yes, DOUBTFUL))

    # the name alone, where it is one entry's
    left = still().select("entry", "name", "total_s")
    alone = left.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name")
    unknown = F.col("total_s").isNull() | F.col("duration_ms").isNull()
    pairs = left.join(alone, "name", "left_semi").join(files.select("file", "name", "duration_ms"), "name").where(unknown | fits)
    add(given(_clear(pairs, now), "filename_only", F.lit(NAME), doubt))
    return now


def match_counts(found: DataFrame) -> DataFrame:
    """(method, sure, doubtful): how many entries each step matched."""
    return found.groupBy("method").agg(F.count(F.when(~F.col("probable"), 1)).alias("sure"), F.count(F.when(F.col("probable"), 1)).alias("doubtful"))

"""The driver's tables read as a catalogue of tracks: bindings shared by the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text

#: Both engines read these: the raw columns of a track by the columns of ``part``.
RAW = {
    "recording_id": "p_partkey",
    "title": "p_name",
    "artist": "CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_brand END",
    "genre": "CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE p_type END",
    "bpm": "CASE WHEN p_size % 10 = 0 THEN NULL ELSE 60 + p_size * 2.5E0 END",
    "key_order": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_partkey % 24 + 2 AS INTEGER) END",
    "energy": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size % 10 + 1 AS INTEGER) END",
    "rating": "CAST(p_partkey % 6 AS INTEGER)",
    "time_ms": "CASE WHEN p_partkey % 400 = 0 THEN NULL ELSE p_partkey % 400 * 1000 END",
    "format": "CASE p_partkey % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN 'flac' WHEN 2 THEN 'wav' ELSE 'aiff' END",
    "bits": "CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE 2 END + CASE WHEN p_partkey % 23 = 0 THEN 4 ELSE 0 END"
    " + CASE WHEN p_partkey % 7 = 0 THEN 8 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 32 ELSE 0 END"
    " + CASE WHEN p_partkey % 11 = 0 THEN 64 ELSE 0 END + CASE WHEN p_partkey % 29 = 0 THEN 128 ELSE 0 END AS BIGINT)",
}


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived row of each track: raw columns, sort keys and flags."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(*(F.expr(e).alias(c) for c, e in RAW.items()))
    return rows.withColumns(
        {
            "title_key": text.sort_key(F.col("title")),
            "artist_key": text.sort_key(F.col("artist")),
            "genre_group": text.genre_group(F.col("genre")),
            "added_at": F.lit(None).cast("timestamp"),
            "file_key": F.col("title"),
            "folder_key": F.col("artist"),
            "flags": F.col("bits") + F.shiftleft(F.coalesce("energy", F.lit(0)).cast("long"), 8),
        }
    ).drop("bits")


TRACKS_SQL = (
    "raw AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RAW.items()) + " FROM part), "
    "tracks AS (SELECT *, lower(title) AS title_key, lower(artist) AS artist_key, lower(trim(genre)) AS genre_group, "
    "bits + coalesce(energy, 0) * 256 AS flags FROM raw)"
)

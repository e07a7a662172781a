import unicodedata
from datetime import date

from pyspark.sql import functions as F

from shelfspark.functions import music, text


def values(spark, xs, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_sort_key(spark):
    xs = ["Été", "Ångström", "ＡＢＣ", "straße", "ﬁ", "naïve Ω", None, "e\u0301"]
    key = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()
    assert values(spark, xs, text.sort_key) == [x if x is None else key(x) for x in xs]


def test_parsers(spark):
    assert values(spark, ["128", "128 BPM", "127,5", "1,275", "19", "abc", "90.25bpm", ""], text.parse_bpm) == [128, 128, 127.5, None, None, None, 90.25, None]
    assert values(spark, ["1999", "2001-05-03", "99", "12345", "x"], text.parse_year) == [1999, 2001, None, None, None]
    assert values(spark, ["energy 7", "Energy Level 10", "nice E5 tune", "E11", "level"], text.parse_energy) == [7, 10, 5, None, None]
    assert values(spark, ["0", "255", "", "51", "52", "x"], text.stars_of) == [0, 5, 0, 1, None, None]
    assert values(spark, ["us-abc 12 34567", "short"], text.isrc) == ["USABC1234567", None]
    assert values(spark, ["set 2023-02-30 2024-02-29", "none"], text.date_in) == [date(2024, 2, 29), None]
    assert values(spark, ["hello /* a / b */ x"], text.tags_in_comment) == [["a", "b"]]
    assert values(spark, ["hello /* a */"], text.without_tags) == ["hello"]
    assert values(spark, ["Song (feat. X) live", "Song ft. Y", "Left"], text.drop_featuring) == ["Song live", "Song", "Left"]
    assert values(spark, ["Ünder & Over!! (ft. Z)"], text.title_key) == ["under over"]


def test_paths(spark):
    path = ["/C:/Music/a b+c (1)/ü,x&.mp3", "plain.wav"]
    coded = values(spark, path, text.location_encode)
    assert values(spark, coded, text.location_decode) == path
    assert values(spark, ["a/b/c.mp3", "x"], text.folder_of) == ["a/b", ""]
    assert values(spark, ["a/b/c.mp3", "x.y.flac", ".hidden"], text.file_name_text) == ["c", "x.y", ".hidden"]
    assert values(spark, ['<a> & "b"\x01'], text.xml_escape) == ["&lt;a&gt; &amp; &quot;b&quot;�"]


def test_keys_and_tempo(spark):
    rows = spark.createDataFrame([(16, 16), (16, 18), (16, 17), (16, 20), (16, 19), (2, 24), (16, 8), (16, None)], "a int, b int")
    assert [r[0] for r in rows.select(music.key_relation(F.col("a"), F.col("b"))).collect()] == ["same", "adjacent", "relative", "two", "diagonal", "adjacent", "far", None]
    gaps = spark.createDataFrame([(100.0, 101.0), (100.0, 51.0), (100.0, 198.0), (100.0, None)], "t double, b double")
    assert [r[0] for r in gaps.select(music.tempo_gap(F.col("t"), F.col("b"))).collect()] == [1.0, 2.0, -1.0, None]
    assert values(spark, [1, 7, 10, None], lambda c: music.energy_of(music.energy_bits(c)), "int") == [1, 7, 10, 0]
    fits = spark.createDataFrame([(10, 9500), (10, 11499), (10, 11500), (10, 9499)], "t int, d long")
    assert [r[0] for r in fits.select(music.duration_fits(F.col("t"), F.col("d"))).collect()] == [True, True, False, False]

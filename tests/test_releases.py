"""Names read whole, one plan for many cases."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import releases

# name, title, labels, labels that may be the title's, unknown brackets
TITLES = [
    ("Low Tide (Extended Mix)", "Low Tide", "extended", "", ""),
    ("Low Tide (Original Mix (Remastered))", "Low Tide", "original remaster", "", ""),
    ("Low Tide (Ana Bo Extended Remix)", "Low Tide", "extended remix=Ana Bo", "", ""),
    ("Low Tide {Ana Bo Remix [Clean", "Low Tide", "remix=Ana Bo clean", "", ""),
    ("Low Tide (Radio / Edit)", "Low Tide", "radio_edit", "", ""),
    ("Low Tide (Radio / Clean)", "Low Tide", "radio_edit clean", "", ""),
    ("Low Tide (Re-Fix)", "Low Tide", "rework", "", ""),
    ("Low Tide (V.I.P.)", "Low Tide", "vip", "", ""),
    ("Low Tide (Live at Pier Hall)", "Low Tide", "live=Pier Hall", "", ""),
    ("Low Tide (at Pier Hall)", "Low Tide", "", "", "at Pier Hall"),
    ("Low Tide (Ana Bo Mix)", "Low Tide", "remix=Ana Bo", "", ""),
    ("Low Tide (Main Mix)", "Low Tide", "", "", "Main Mix"),
    ("Low Tide (@who edit)", "Low Tide", "bootleg=@who", "", ""),
    ("Low Tide (Ana Clean)", "Low Tide", "", "", "Ana Clean"),
    ("Low Tide - Extended Mix", "Low Tide", "extended", "", ""),
    ("Low Tide – Radio Edit — Clean", "Low Tide", "radio_edit clean", "", ""),
    ("Low Tide - Reprise", "Low Tide - Reprise", "", "", ""),
    ("Low Tide Extended Mix", "Low Tide Extended Mix", "", "extended", ""),
    ("Low Tide (2019 Remaster)", "Low Tide", "remaster=2019", "", ""),
    ("Low Tide (Remastered Version 2019)", "Low Tide", "remaster=2019", "", ""),
    ("Low Tide (Intro + Outro)", "Low Tide", "intro_outro", "", ""),
    ("Low (Not This) Tide (Clean)", "Low (Not This) Tide", "clean", "", ""),
    ("Low Tide ((Dub))", "Low Tide", "dub", "", ""),
    ("Low Tide [Extended (Odd]", "Low Tide", "extended", "", "Odd"),
    ("Low Tide (Dub) (2)", "Low Tide", "dub", "", "2"),
    ("Low Tide, Pt. (2)", "Low Tide, Pt.", "", "", "2"),
    ("(Intro)", "(Intro)", "", "intro", ""),
    ("Velo (dirty) (dirty)", "Velo (dirty)", "dirty", "dirty", ""),
    ("Low Tide)", "Low Tide)", "", "", ""),
    ("Low Tide (Short Edit) [HQ] (www.some.site)", "Low Tide", "short", "", ""),
    ("Low&#32;Tide&nbsp;(Acapella)", "Low Tide", "acapella", "", ""),
    ("((((((((((deep))))))))))", "((((((((((deep))))))))))", "", "", ""),
    ("()", "()", "", "", ""),
    ("", "", "", "", ""),
    (None, None, None, None, None),
]
# file name, artist, credits, title, labels, asides
FILES = [
    ("01. Ana Bo & Cy feat. Ed - Low Tide (Quick Hit Dirty).mp3", "Ana Bo & Cy feat. Ed", "Ana Bo,Cy,+Ed", "Low Tide", "quick_hit dirty", ""),
    ("Ana x Bo - Low Tide (feat. Cy, Ed).wav", "Ana x Bo", "Ana,Bo,+Cy,+Ed", "Low Tide", "", ""),
    ("a/b/A1 - Ana - Low Tide [ABC-123] (8A).flac", "Ana", "Ana", "Low Tide", "", "catalogue:ABC123 key:8a"),
    ("some.site - Ana - Low Tide - Radio Edit [124 BPM].mp3", "Ana", "Ana", "Low Tide", "radio_edit", "tempo:124"),
    ("Ana - Intro.mp3", "Ana", "Ana", "Intro", "", ""),
    ("123456_Ana_Bo_-_Low_Tide.mp3", "Ana Bo", "Ana Bo", "Low Tide", "", ""),
    ("7 Lamps.mp3", None, "", "7 Lamps", "", ""),
    (".mp3", None, "", ".mp3", "", ""),
]


def said(labels):
    return " ".join(x.kind + (f"={x.detail}" if x.detail else "") for x in labels)


def test_titles(spark):
    df = releases.parse_releases(spark.createDataFrame([(i, t[0]) for i, t in enumerate(TITLES)], "i int, n string"), F.col("n"), "p", False)
    assert df.columns == ["i", "n", "p"]
    for r in df.collect():
        want = TITLES[r.i][1:]
        got = (r.p.title, said(r.p.labels), said(r.p.maybe), ",".join(r.p.unknown)) if r.p else (None,) * 4
        if r.n and r.n.startswith("((("):
            assert "deep" in got[0]
        else:
            assert got == want, r.n


def test_files(spark):
    df = releases.parse_releases(spark.createDataFrame([(i, t[0]) for i, t in enumerate(FILES)], "i int, n string"), F.col("n"), "p")
    for r in df.collect():
        got = (r.p.artist, ",".join("+" * c.featured + c.name for c in r.p.credits), r.p.title, said(r.p.labels), " ".join(f"{a.kind}:{a.value}" for a in r.p.asides))
        assert got == FILES[r.i][1:], r.n


PAIRS = [
    ("Ana - Low Tide", "ana & Bo - LOW TIDE (Original Mix)", "same"),
    ("Ana - Low Tide (Bo Remix)", "Bo - Low Tide (Bo Remix)", "same"),
    ("Ana - Low Tide (Bo Remix)", "Ana - Low Tide (Bo's Remix)", "same"),
    ("Ana - Low Tide Extended Mix", "Ana - Low Tide (Extended)", "same"),
    ("Ana - Low Tide (Extended)", "Ana - Low Tide Extended Mix", "same"),
    ("Ana - Low Tide (Instrumental)", "Ana - Low Tide", "rework"),
    ("Ana - Low Tide (Bo Remix)", "Ana - Low Tide (Remix)", "unclear"),
    ("Ana - Low Tide (2009 Remaster)", "Ana - Low Tide (Remaster)", "same"),
    ("Ana - Low Tide (2009 Remaster)", "Ana - Low Tide (2010 Remaster)", "cut"),
    ("Ana - Low Tide (1)", "Ana - Low Tide (2)", "same"),
    ("Ana - Low Tide (2001)", "Ana - Low Tide (2002)", "unclear"),
    ("Cy - Low Tide", "Ana - Low Tide", "artists"),
    ("Ana - Low Tide vs. High", "Ana - High", "mashup"),
    ("Ana - Low Tide", "Ana - High", "title"),
    (None, "Ana - High", None),
]


@pytest.mark.parametrize("swap", [False, True])
def test_relations(spark, swap):
    df = spark.createDataFrame([(i, p[swap], p[not swap]) for i, p in enumerate(PAIRS)], "i int, x string, y string")
    df = releases.parse_releases(releases.parse_releases(df, F.col("x"), "a"), F.col("y"), "b")
    for r in releases.relate(df, "a", "b").collect():
        assert r.relation == PAIRS[r.i][2], (r.x, r.y)


def test_each_name_is_read_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (5, "a")], "i int, n string")
    seen = []

    def work(names):
        seen.append((sorted(r.n or "" for r in names.collect()), names.rdd.getNumPartitions()))
        return names.withColumn("x", F.upper("n"))

    assert {r.i: r.x for r in releases.each_once(rows, ["n"], work).collect()} == {1: "A", 2: "A", 3: None, 4: "B", 5: "A"}
    assert seen == [(["", "a", "b"], spark.sparkContext.defaultParallelism)]

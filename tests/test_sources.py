from xml.etree import ElementTree

from shelfspark.sources import readers, tree_document

XML = """<?xml version="1.0" encoding="UTF-8"?>
<DJ_PLAYLISTS Version="1.0.0"><COLLECTION Entries="2">
<TRACK TrackID="1" Name="One &amp; Two" Artist="É" TotalTime="180" AverageBpm="128.00" Tonality="8A" Rating="255" Location="file://localhost/C:/a%20b+c.mp3">
<TEMPO Inizio="2.75" Bpm="93.4" Metro="3/4" Battito="3"/><TEMPO Inizio="61.5" Bpm="171.25" Metro="5/4" Battito="2"/>
<POSITION_MARK Name="in" Type="0" Start="0.5" Num="0"/></TRACK>
<TRACK TrackID="2" Name="Three" Artist="" Location="x"/>
</COLLECTION><PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Name="mine" Type="1" KeyType="0" Entries="3"><TRACK Key="2"/><TRACK Key="1"/><TRACK Key="2"/></NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>"""


def test_collection(spark, tmp_path):
    (tmp_path / "c.xml").write_text(XML)
    rows = {r.trackid: r for r in readers.collection_xml(spark, str(tmp_path / "c.xml")).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].name == "One & Two" and rows[1].path == "C:/a b+c.mp3" and rows[1].averagebpm == 128.0
    assert [t._Bpm for t in rows[1].tempo] == [93.4, 171.25] and rows[1].position_mark[0]._Name == "in"


def test_written_collection_is_read_back(spark, tmp_path):
    rows = [(1, "A <b> & \"c\"", 120), (2, "é", None)]
    readers.write_collection(spark.createDataFrame(rows, "TrackID long, Name string, TotalTime int"), str(tmp_path / "out"))
    back = readers.collection_xml(spark, str(tmp_path / "out")).select("trackid", "name", "totaltime").orderBy("trackid").collect()
    assert [tuple(r) for r in back] == rows


def test_m3u8(spark, tmp_path):
    (tmp_path / "s.m3u8").write_bytes("\ufeff#EXTM3U\r\n#EXTINF:201,Who - What (Mix)\r\n/m/a.mp3\r\n#EXTINF:bad\r\nb.mp3\r\nc.mp3\r\n".encode())
    got = readers.m3u8_sessions(spark, str(tmp_path / "s.m3u8")).orderBy("position").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 201, "Who", "What (Mix)", "/m/a.mp3"), (1, None, None, None, "b.mp3"), (2, None, None, None, "c.mp3")]


def test_wishes(spark, tmp_path):
    (tmp_path / "w.csv").write_text('Track Name,Artist Name(s),ISRC\n"Say ""Hi"", you",X,us-abc-12-34567\n,Y,\n')
    assert [tuple(r) for r in readers.wish_csv(spark, str(tmp_path / "w.csv")).collect()] == [("X", 'Say "Hi", you', None, "USABC1234567")]
    lines = spark.createDataFrame([("1. 00:12 Me - Song (Dub)",), ("just words",), ("  ",)], "value string")
    assert [tuple(r) for r in readers.pasted(lines).collect()] == [("Me", "Song", "Dub"), (None, "just words", None)]


def test_document_is_read_in_splits(spark, tmp_path):
    """Elements, attributes and nested nodes that begin in one split and end in another."""
    track = '<TRACK TrackID="{0}" Name="a > b &lt;{0}&gt; /" Location=\'"{0}"\'>\n<TEMPO Inizio="1.5" Bpm="90.0"/>\n</TRACK>\n'
    lists = "".join(f'<NODE Name="n &amp; {k}" Type="1" KeyType="{k % 2}">' + "".join(f'<TRACK Key="{k}/{j}"/>\n' for j in range(k % 4 * 9)) + "</NODE>\n" for k in range(12))
    tree = f"<NODE Type='0' Name='ROOT'>{lists}<NODE Type=\"0\" Name='in \"it\"'>{lists}<NODE Type=\"0\" Name=\"deep\"><NODE Type=\"0\" Name=\"deeper\"/>{lists}</NODE></NODE>\n{lists}</NODE>"
    path = str(tmp_path / "d.xml")
    xml = "<DJ_PLAYLISTS><COLLECTION>" + "".join(track.format(k) for k in range(40)) + '<TRACK TrackID="40" Name="x/"/></COLLECTION>\n<PLAYLISTS>' + tree + "</PLAYLISTS></DJ_PLAYLISTS>"
    (tmp_path / "d.xml").write_text(xml)
    want_nodes, want_entries = [], []

    def walk(x, node, parent, place):
        want_nodes.append((node, parent, place, x.get("Name"), x.get("Type") == "0", int(x.get("KeyType") or 0)))
        want_entries.extend((node, k, t.get("Key")) for k, t in enumerate(x.findall("TRACK")))
        for k, y in enumerate(x.findall("NODE")):
            walk(y, f"{node}.{k}", node, k)

    walk(ElementTree.fromstring(xml).find("PLAYLISTS/NODE"), "0", None, 0)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    for size in ("700", before):
        spark.conf.set(setting, size)
        tracks = readers.collection_xml(spark, path)
        assert size == before or tracks.rdd.getNumPartitions() > 5
        got = sorted((r.trackid, r.name, r.location, [t._Bpm for t in r.tempo or []]) for r in tracks.collect())
        assert got == [(k, f"a > b <{k}> /", f'"{k}"', [90.0]) for k in range(40)] + [(40, "x/", None, [])]
        nodes, entries = tree_document.read_tree(spark, path)
        rows = sorted((tuple(r) for r in nodes.select("node", "parent", "place", "name", "folder", "key_type").collect()), key=lambda r: r[0])
        assert rows == sorted(want_nodes, key=lambda r: r[0])
        assert sorted(tuple(r) for r in entries.select("node", "place", "key").collect()) == sorted(want_entries)
        cut, below = tree_document.read_tree(spark, path, 1)
        assert cut.count() == sum(r[0].count(".") <= 1 for r in want_nodes) and below.count() == sum(e[0].count(".") <= 1 for e in want_entries)
    spark.conf.set(setting, before)

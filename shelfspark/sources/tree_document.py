"""Trees of folders and playlists: read from a collection document, resolved, and written with its tracks as one document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions import text
from shelfspark.storage import new_path, remove, stored

#: Folders in folders that a reader looks into.
MOST_LEVELS = 32
#: Digits of a place in a sort key.
DIGITS = 9


def read_tree(spark: SparkSession, path: str, levels: int = MOST_LEVELS) -> tuple[DataFrame, DataFrame]:
    """(nodes, entries) of the playlists of a collection document.

    nodes(node, parent, place, name, folder, key_type): ``node`` is the node's place in its
    file and tree ("0.2.1"), so that it tells nodes apart; the top has no parent. entries(node, place, key).
    Folders deeper than ``levels`` are not looked into.

    The document is read tag by tag, so Spark splits a file of any size, within one element
    too. What spans splits is carried from one to the next in a few rows for each split.
    Tags in comments count as tags.
    """
    tags = _levelled(_tags(spark, path)).where((F.col("level") >= F.when(F.col("kind") == "TRACK", 1).otherwise(0)) & (F.col("level") <= F.when(F.col("kind") == "TRACK", levels + 1).otherwise(levels)))
    members = stored(_placed(stored(tags, "tree-tags")), "tree-members")
    own = members.where("kind = 'NODE'")
    below = lambda d: own.where(F.col("level") == d)
    fields = (F.col("name"), (F.col("type") == 0).alias("folder"), F.coalesce("key_type", F.lit(0)).alias("key_type"))
    level = stored(below(0).select("at", F.col("place").cast("string").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("place"), *fields), "tree-top")
    out = level
    for depth in range(1, (own.agg(F.max("level")).first()[0] or 0) + 1):
        above = level.select(F.col("at").alias("up"), F.col("node").alias("parent"))
        found = below(depth).join(above, "up").select("at", F.concat_ws(".", "parent", F.col("place").cast("string")).alias("node"), "parent", "place", *fields)
        level = stored(found, "tree-level")
        out = out.unionByName(level)
    lists = out.select(F.col("at").alias("up"), "node", F.col("key_type").alias("kind_of_key"))
    entries = members.where("kind = 'TRACK'").join(lists, "up").select("node", F.col("kind_of_key").alias("key_type"), "place", "key")
    return out.drop("at"), entries


def _tags(spark: SparkSession, path: str) -> DataFrame:
    """(block, at, kind, step, type, name, key_type, key): the tags NODE and TRACK and the ends of nodes.

    A record ends before the next "<", which XML has nowhere inside a tag. ``block`` is the
    split, (file, start): blocks, and within one ``at``, are in the document's order.
    ``step`` is what the tag adds to the number of open nodes.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.option("lineSep", "<").text(path).select(place.alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = rows.select("block", "at", F.regexp_extract("value", r"^(NODE|/NODE|TRACK)[\s/>]", 1).alias("kind"), "value").where("kind <> ''")
    inside = F.regexp_extract("value", r"""^\w+((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""", 1)
    rows = rows.withColumn("inside", F.when(F.col("kind") != "/NODE", inside))
    whole = F.concat(F.lit("<NODE"), F.regexp_replace("inside", "/$", ""), F.lit("/>"))
    x = F.from_xml(whole, "_Type INT, _Name STRING, _KeyType INT, _Key STRING")
    step = F.when(F.col("kind") == "/NODE", -1).when((F.col("kind") == "NODE") & ~F.endswith("inside", F.lit("/")), 1).otherwise(0)
    rows = rows.select("block", "at", "kind", step.alias("step"), x.alias("x"))
    return stored(rows.select("block", "at", "kind", "step", F.col("x._Type").alias("type"), F.col("x._Name").alias("name"), F.col("x._KeyType").alias("key_type"), F.col("x._Key").alias("key")), "tree-read")


def _levelled(tags: DataFrame) -> DataFrame:
    """The tags NODE and TRACK with ``level``, the number of nodes that are open before them; blocks are numbered in order."""
    before = W.rowsBetween(W.unboundedPreceding, -1)
    blocks = tags.groupBy("block").agg(F.sum("step").alias("steps"))  # one row for each split
    blocks = blocks.select(F.col("block").alias("of"), F.row_number().over(W.orderBy("block")).alias("no"), F.coalesce(F.sum("steps").over(before.orderBy("block")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("step").over(before.partitionBy("block").orderBy("at")), F.lit(0))
    rows = tags.withColumn("within", within).where("kind <> '/NODE'").join(F.broadcast(blocks), F.col("block") == F.col("of"))
    return rows.withColumn("level", (F.col("base") + F.col("within")).cast("int")).withColumn("block", F.col("no")).drop("of", "no", "base", "within", "step")


def _placed(tags: DataFrame) -> DataFrame:
    """``tags`` with ``up``, the ``at`` of the node around them (-1 at the top), and ``place`` among its children of their kind.

    Each node is a mark to the tags one level below it: the last mark before a tag is the node around it.
    """
    before = W.rowsBetween(W.unboundedPreceding, -1)
    mark, of = F.struct(F.col("level").alias("group"), F.lit(True).alias("mark")), F.struct((F.col("level") - 1).alias("group"), F.lit(False).alias("mark"))
    rows = tags.withColumn("as", F.explode(F.when(F.col("kind") == "NODE", F.array(mark, of)).otherwise(F.array(of)))).select("*", "as.*").drop("as")
    last = rows.where("mark").groupBy("block", "group").agg(F.max("at").alias("last"))
    every = rows.select("block").distinct().crossJoin(last.select("group").distinct())  # one row for each split and level
    carried = every.join(last, ["block", "group"], "left").withColumn("since", F.last("last", True).over(before.partitionBy("group").orderBy("block")))
    carried = carried.where("since IS NOT NULL").select(F.col("block").alias("b"), F.col("group").alias("g"), "since")
    within = F.last(F.when(F.col("mark"), F.col("at")), True).over(before.partitionBy("block", "group").orderBy("at"))
    rows = rows.withColumn("within", within).where("NOT mark").join(F.broadcast(carried), (F.col("block") == F.col("b")) & (F.col("group") == F.col("g")), "left")
    rows = rows.withColumn("up", F.coalesce("within", "since", F.lit(-1)))
    rows = stored(rows.select(*tags.columns, "up"), "tree-children")
    # children of what stays open from one split to the next
    open_ = carried.select(F.col("since").alias("up")).union(tags.sparkSession.range(1).select(F.lit(-1).cast("long"))).distinct()
    counts = rows.groupBy("up", "kind", "block").agg(F.count("*").alias("n")).join(F.broadcast(open_), "up", "left_semi")
    earlier = F.coalesce(F.sum("n").over(before.partitionBy("up", "kind").orderBy("block")), F.lit(0))
    counts = counts.select(F.col("up").alias("u"), F.col("kind").alias("k"), F.col("block").alias("b"), earlier.alias("earlier"))
    number = F.row_number().over(W.partitionBy("block", "up", "kind").orderBy("at")) - 1
    rows = rows.withColumn("number", number).join(F.broadcast(counts), (F.col("up") == F.col("u")) & (F.col("kind") == F.col("k")) & (F.col("block") == F.col("b")), "left")
    return rows.select(*tags.columns, "up", (F.col("number") + F.coalesce("earlier", F.lit(0))).cast("int").alias("place"))


def paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with path (names from below the top, as an array), order (a sort key: depth first, by place) and depth.

    ``nodes(node, parent, place, name)``. A recursive query walks from the tops down, a level a
    step, so a tree of any size is joined once for each of its levels. Nodes that no top
    leads to are not in the result.
    """
    spark = nodes.sparkSession
    own = stored(nodes, "tree-own")
    own.createOrReplaceTempView("tree_own")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        walked = spark.sql(f"""
            WITH RECURSIVE walk(node, path, ord, depth) AS (
              SELECT node, CAST(array() AS ARRAY<STRING>), lpad(CAST(place AS STRING), {DIGITS}, '0'), 0 FROM tree_own WHERE parent IS NULL
              UNION ALL
              SELECT t.node, concat(w.path, array(t.name)), concat(w.ord, '.', lpad(CAST(t.place AS STRING), {DIGITS}, '0')), w.depth + 1
              FROM walk w JOIN tree_own t ON t.parent = w.node
            ) SELECT node, path, ord AS `order`, depth FROM walk""")
        walked = stored(walked, "tree-paths")
    finally:
        spark.conf.set(limit, before) if before is not None else spark.conf.unset(limit)
        spark.catalog.dropTempView("tree_own")
    return own.join(walked, "node")


def location_key(location: Column) -> Column:
    """What locations are matched by: decoded, with forward slashes, case folded."""
    return F.lower(F.replace(text.location_decode(location), F.lit("\\"), F.lit("/")))


def resolve_entries(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """``entries`` with track and found_by (id, location, or null for one that points at no track).

    ``entries(.., key_type, key)``: by id (0) or by location (1). ``tracks(track, id, location)``;
    of several tracks with an id or a location the first (least ``track``) counts.
    """
    number = F.when(F.col("key").rlike("^[0-9]+$"), F.col("key").try_cast("long"))
    by_id = tracks.where("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("id__")).agg(F.min("track").alias("track_a"))
    by_location = tracks.groupBy(location_key(F.col("location")).alias("at__")).agg(F.min("track").alias("track_b")).where("at__ IS NOT NULL")
    own = entries.withColumn("want_id__", F.when(F.col("key_type") == 0, number)).withColumn("want_at__", F.when(F.col("key_type") == 1, location_key(F.col("key"))))
    met = own.join(by_id, F.col("want_id__") == F.col("id__"), "left").join(by_location, F.col("want_at__") == F.col("at__"), "left")
    found = F.when(F.col("track_a").isNotNull(), "id").when(F.col("track_b").isNotNull(), "location")
    return met.select(*(F.col(f"`{c}`") for c in entries.columns), F.coalesce("track_a", "track_b").alias("track"), found.alias("found_by"))


def _element(name: str, fields: Mapping[str, Column], end: str) -> Column:
    """An element's tag; attributes that are null are left out."""
    written = [F.coalesce(F.concat(F.lit(f' {k}="'), text.xml_escape(v.cast("string")), F.lit('"')), F.lit("")) for k, v in fields.items()]
    return F.concat(F.lit(f"<{name}"), *written, F.lit(end))


def document_lines(tracks: DataFrame, order: str, fields: Mapping[str, Column], nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(section, at, line): a collection document, line by line; (section, at) tells lines apart and puts them in order.

    ``tracks`` in the order of ``order`` with ``fields`` as attributes; ``nodes(node, parent,
    place, name, folder)`` and ``entries(node, place, key)`` as ``read_tree`` gives them.
    Counts are worked out from the rows.
    """
    spark = tracks.sparkSession
    walked = stored(paths(nodes), "document-nodes")
    head = [(0, "0", '<?xml version="1.0" encoding="UTF-8"?>'), (0, "1", '<DJ_PLAYLISTS Version="1.0.0">'), (3, "0", "</COLLECTION>"), (3, "1", "<PLAYLISTS>"), (5, "0", "</PLAYLISTS>"), (5, "1", "</DJ_PLAYLISTS>")]
    fixed = spark.createDataFrame(head, "section int, at string, line string")
    key = F.lpad(F.col(order).cast("string"), 20, "0")
    counted = tracks.agg(F.count("*").alias("n")).select(F.lit(1).alias("section"), F.lit("").alias("at"), F.concat(F.lit('<COLLECTION Entries="'), F.col("n").cast("string"), F.lit('">')).alias("line"))
    rows = tracks.select(F.lit(2).alias("section"), key.alias("at"), _element("TRACK", fields, "/>").alias("line"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    filled = entries.groupBy("node").agg(F.count("*").alias("entries"))
    full = walked.join(children, "node", "left").join(filled, "node", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    folder = _element("NODE", {"Type": F.lit("0"), "Name": F.col("name"), "Count": zero("children")}, ">")
    listed = _element("NODE", {"Name": F.col("name"), "Type": F.lit("1"), "KeyType": F.lit("0"), "Entries": zero("entries")}, ">")
    opened = full.select(F.lit(4).alias("section"), F.col("order").alias("at"), F.when(F.col("folder"), folder).otherwise(listed).alias("line"))
    closed = walked.select(F.lit(4).alias("section"), F.concat("order", F.lit("~")).alias("at"), F.lit("</NODE>").alias("line"))
    inside = entries.join(walked.select("node", "order"), "node")
    inside = inside.select(F.lit(4).alias("section"), F.concat("order", F.lit("."), F.lpad(F.col("place").cast("string"), DIGITS, "0")).alias("at"), _element("TRACK", {"Key": F.col("key")}, "/>").alias("line"))
    return fixed.unionByName(counted).unionByName(rows).unionByName(opened).unionByName(inside).unionByName(closed)


def write_document(lines: DataFrame, path: str) -> None:
    """Write lines (section, at, line) in order as one file, the same to the byte for any number of partitions.

    Tasks write ranges of lines as text parts; the parts' bytes are then put one behind the
    other by the file system's own streams, a small buffer at a time. A file appears only when whole.
    """
    spark = lines.sparkSession
    parts = new_path(spark, "document-parts")
    lines.repartitionByRange("section", "at").sortWithinPartitions("section", "at").select("line").write.text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    target, half = hadoop.fs.Path(path), hadoop.fs.Path(f"{path}.part")
    fs = target.getFileSystem(conf)
    found = fs.listStatus(hadoop.fs.Path(parts))
    ordered = sorted(str(s.getPath()) for s in found if s.getPath().getName().startswith("part-"))
    out = fs.create(half, True)
    try:
        for p in ordered:
            stream = fs.open(hadoop.fs.Path(p))
            try:
                hadoop.io.IOUtils.copyBytes(stream, out, 65536, False)
            finally:
                stream.close()
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(half, target):
        raise OSError(f"cannot write {path}")
    remove(spark, parts)

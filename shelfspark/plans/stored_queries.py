"""Queries over tables that Spark writes and keeps current: the posting index, keyed tables, the change log that replays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import changelog, search_index
from shelfspark.plans.queries import query, table
from shelfspark.sources import readers, tree_document
from shelfspark.sources.keyed_table import KeyedTable
from shelfspark.storage import new_path

WORDS_SQL = "SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_index.build(table(spark, sf_dir, "documents"), "doc_id", ["source", "text"], new_path(spark, "postings"))


@query(f"WITH d AS ({WORDS_SQL}), p AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i, w FROM d) SELECT DISTINCT doc_id AS id FROM p WHERE token = 'of' AND starts_with(w[i + 1], 'th') AND doc_id IN (SELECT doc_id FROM p WHERE starts_with(token, 'an'))")
def phrase_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of two tokens (they follow one another) and a beginning, both required."""
    return search_index.find(_index(spark, sf_dir), "of/th an")


@query(f"WITH d AS ({WORDS_SQL} UNION ALL SELECT doc_id, regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}]+') FROM documents), t AS (SELECT DISTINCT doc_id, unnest(w) AS token FROM d) SELECT token, count(*) AS rows FROM t WHERE starts_with(token, 'on') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def suggest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_index.suggest(_index(spark, sf_dir), "ON")


@query(
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'zeta ' || source ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0) "
    "SELECT doc_id AS id FROM d WHERE regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])zeta') OR (regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])zet'))"
)
def refreshed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows get new texts, a seventh goes; the index follows without the others' texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = search_index.build(docs, "doc_id", ["text"], new_path(spark, "postings"))
    text = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("zeta "), "source"))
    changed = docs.where("doc_id % 3 = 0 OR doc_id % 7 = 0").select("doc_id", text.alias("text"))
    changed = changed.unionByName(docs.where("doc_id % 3 <> 0 AND doc_id % 7 = 0").select("doc_id", F.lit(None).cast("string").alias("text")))
    return search_index.find(search_index.refreshed(index, changed, "doc_id", ["text"], new_path(spark, "postings")), "zet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))


def _kept(spark: SparkSession, columns: str, key: list[str]) -> KeyedTable:
    return KeyedTable(spark, new_path(spark, "keyed"), key, columns)


@query(
    "SELECT o_orderkey, o_custkey AS cust, CASE WHEN o_orderkey % 5 = 0 THEN 'z' || (o_orderkey % 7) WHEN o_orderkey % 3 = 0 THEN 'n' ELSE o_orderstatus END AS status FROM orders "
    "WHERE CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 25 <> 0 WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 <> 0 ELSE o_orderkey % 2 = 0 END"
)
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot, two batches of changes (the second with two changes a key, and sent twice) and a compaction between them."""
    rows = _orders(spark, sf_dir)
    kept = _kept(spark, "o_orderkey long, cust long, status string", ["o_orderkey"])
    kept.replace(rows.where("o_orderkey % 2 = 0"))
    kept.upsert(rows.where("o_orderkey % 3 = 0").withColumn("status", F.lit("n")), gone=F.col("o_orderkey") % 9 == 0, source="orders", batch=1)
    kept.compact()
    turn = F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")
    second = rows.where("o_orderkey % 5 = 0").select("o_orderkey", "cust", turn)
    second = second.withColumn("status", F.when(F.col("turn") == 0, "early").otherwise(F.concat(F.lit("z"), F.col("o_orderkey") % 7)))
    for _ in range(2):
        kept.upsert(second, order=F.col("turn"), gone=F.col("o_orderkey") % 25 == 0, source="orders", batch=2)
    return kept.read()


@query("SELECT 1 AS version, o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, o_orderkey, lower(o_orderstatus) FROM orders WHERE o_orderkey % 3 = 0")
def snapshot_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table replaced; what was read before stays readable."""
    rows = _orders(spark, sf_dir).select("o_orderkey", "status")
    kept = _kept(spark, "o_orderkey long, status string", ["o_orderkey"])
    kept.replace(rows.where("o_orderkey % 2 = 0"))
    kept.replace(rows.where("o_orderkey % 3 = 0").withColumn("status", F.lower("status")))
    versions = [kept.read(v).select(F.lit(v).alias("version"), "o_orderkey", "status") for v in (1, 2)]
    return reduce(DataFrame.unionByName, versions)


@query(
    "SELECT CASE WHEN k % 3 = 0 THEN 'changed' WHEN k % 5 = 0 THEN 'gone' ELSE 'same' END AS change, count(*) AS n FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 0) GROUP BY 1 "
    "UNION ALL SELECT 'new', count(*) FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 3 = 0"
)
def written_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived rows that differ from the stored ones are written, and only those: counted by what happened to them."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    kept = _kept(spark, "p_partkey long, size long", ["p_partkey"])
    kept.replace(part.where("p_partkey % 2 = 0"))
    derived = part.where("(p_partkey % 2 = 0 AND p_partkey % 5 <> 0) OR p_partkey % 3 = 0").withColumn("size", F.expr("size + IF(p_partkey % 3 = 0, 1, 0)"))
    return kept.sync(derived).groupBy("change").agg(F.count("*").alias("n"))


LOG = "seq long, operation long, entity string, id long, field string, before string, after string, undone boolean, undoes long"


def _replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, KeyedTable]:
    """Three operations of values from orders, each logged and written to the table of what stands."""
    orders = table(spark, sf_dir, "orders")
    log = spark.createDataFrame([], LOG)
    kept = _kept(spark, "entity string, id long, field string, value string", changelog.KEY)
    kept.replace(spark.createDataFrame([], "entity string, id long, field string, value string"))
    for n in range(3):
        mine = orders.where(f"o_orderkey % 3 = {n}").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("after"))
        new = mine.select(F.lit("customer").alias("entity"), "id", F.lit("status").alias("field"), F.when(F.col("id") % 11 != n, F.col("after")).alias("after"))
        log = changelog.append(log, n + 1, new)
        changelog.write_back(kept, new.withColumnRenamed("after", "value"))
    return log, kept


STATE_SQL = "WITH x AS (SELECT o_orderkey % 3 AS n, o_custkey AS id, CASE WHEN o_custkey % 11 <> o_orderkey % 3 THEN arg_max(o_orderstatus, o_orderkey) END AS v FROM orders GROUP BY 1, 2)"


@query(f"{STATE_SQL}, y AS (SELECT id, arg_max(coalesce(v, ''), n) AS value FROM x WHERE n < 2 GROUP BY 1) SELECT 'customer' AS entity, id, 'status' AS field, value FROM y WHERE value <> ''")
def undo_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands after the last of three operations was taken back and written back: what stood before it."""
    log, kept = _replayed(spark, sf_dir)
    _, values = changelog.undo_next(log)
    changelog.write_back(kept, values)
    return kept.read()


@query(f"{STATE_SQL} SELECT id, v AS value FROM x WHERE n = 0 AND v IS NOT NULL")
def undo_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after two undos says what stood after the first operation."""
    log, _ = _replayed(spark, sf_dir)
    for _ in range(2):
        log, _ = changelog.undo_next(log)
    return changelog.as_of(log, 1 << 62).select("id", "value")


@query(
    f"{STATE_SQL}, y AS (SELECT id, arg_max(coalesce(v, ''), n) AS value FROM x WHERE n < 2 GROUP BY 1), o1 AS (SELECT count(*) AS n FROM x WHERE n = 0 AND v IS NOT NULL), "
    "o2 AS (SELECT count(*) AS n FROM x a LEFT JOIN x b ON b.id = a.id AND b.n = 0 WHERE a.n = 1 AND a.v IS DISTINCT FROM b.v), "
    "o3 AS (SELECT x.id, nullif(y.value, '') AS was, x.v AS now FROM x LEFT JOIN y USING (id) WHERE x.n = 2 AND x.v IS DISTINCT FROM nullif(y.value, '')) "
    "SELECT (SELECT n FROM o1) + (SELECT n FROM o2) + (SELECT count(*) FROM o3) + row_number() OVER (ORDER BY id) AS seq, 4 AS operation, 3 AS undoes, id, now AS before, was AS after FROM o3"
)
def undo_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse changes as the operation that the log gained, consecutively numbered."""
    log, _ = changelog.undo_next(_replayed(spark, sf_dir)[0])
    return log.where("undoes IS NOT NULL").select("seq", "operation", "undoes", "id", "before", "after")


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of three levels below the top: regions, nations and, as playlists, customers."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = spark.range(1).select(F.lit(1).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("place"), F.lit("ROOT").alias("name"), F.lit(True).alias("folder"))
    a = region.select((F.col("r_regionkey") + 10).cast("long").alias("node"), F.lit(1).cast("long").alias("parent"), F.col("r_regionkey").cast("long").alias("place"), F.col("r_name").alias("name"), F.lit(True).alias("folder"))
    b = nation.select((F.col("n_nationkey") + 100).cast("long").alias("node"), (F.col("n_regionkey") + 10).cast("long").alias("parent"), F.col("n_nationkey").cast("long").alias("place"), F.col("n_name").alias("name"), F.lit(True).alias("folder"))
    c = customer.select((F.col("c_custkey") + 1000).alias("node"), (F.col("c_nationkey") + 100).cast("long").alias("parent"), F.col("c_custkey").alias("place"), F.concat("c_name", F.lit(" <&> "), "c_mktsegment").alias("name"), F.lit(False).alias("folder"))
    return top.unionByName(a).unionByName(b).unionByName(c)


@query("SELECT c_custkey + 1000 AS node, r_name || '/' || n_name || '/' || c_name || ' <&> ' || c_mktsegment AS path, 3 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey + 100, r_name || '/' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey + 10, r_name, 1 FROM region UNION ALL SELECT 1, '', 0")
def playlist_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each playlist and folder of a nested tree stands, by a recursive query."""
    return tree_document.paths(_folders(spark, sf_dir)).select("node", F.array_join("path", "/").alias("path"), "depth")


LIST_SQL = "SELECT o_orderkey % 2 AS key_type, o_orderkey AS k, o_custkey + 1000 AS node FROM orders"


@query(
    f"WITH e AS ({LIST_SQL}), r AS (SELECT node, k, CASE WHEN key_type = 0 AND k <= (SELECT max(p_partkey) FROM part) THEN 'id' WHEN key_type = 1 AND k // 2 <= (SELECT max(p_partkey) FROM part) THEN 'location' END AS found_by FROM e) "
    "SELECT coalesce(found_by, 'none') AS found_by, count(*) AS n, count(DISTINCT node) AS lists, sum(CASE found_by WHEN 'id' THEN k WHEN 'location' THEN k // 2 END)::BIGINT AS tracks FROM r GROUP BY 1"
)
def playlist_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries looked up by id or by location (escaped, in another case); those that point at no track are counted."""
    odd, k = F.col("o_orderkey") % 2, F.col("o_orderkey")
    key = F.when(odd == 0, k.cast("string")).otherwise(F.concat(F.lit("file://localhost/C:/Music%20A/"), F.floor(k / 2).cast("string"), F.lit(".MP3")))
    entries = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1000).alias("node"), odd.alias("key_type"), k.alias("place"), key.alias("key"))
    tracks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track"), F.col("p_partkey").alias("id"), F.concat(F.lit("file://localhost/c:/music%20a/"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("location"))
    found = tree_document.resolve_entries(entries, tracks)
    return found.groupBy(F.coalesce("found_by", F.lit("none")).alias("found_by")).agg(F.count("*").alias("n"), F.countDistinct("node").alias("lists"), F.sum("track").alias("tracks"))


@query(
    "SELECT 'track' AS kind, p_name AS name, p_partkey AS key, NULL::BIGINT AS place FROM part UNION ALL "
    "SELECT 'entry', c_name || ' <&> ' || c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL "
    "SELECT 'folder', n_name, NULL, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation"
)
def collection_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks, nested folders, playlists and entries written as one ordered document and read back from it."""
    part, orders, nodes = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders"), _folders(spark, sf_dir)
    entries = orders.select((F.col("o_custkey") + 1000).alias("node"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").alias("key"))
    fields = {"TrackID": F.col("p_partkey"), "Name": F.col("p_name"), "Artist": F.col("p_brand"), "Genre": F.when(F.col("p_partkey") % 5 != 0, F.col("p_type"))}
    path = new_path(spark, "collection") + ".xml"
    tree_document.write_document(tree_document.document_lines(part, "p_partkey", fields, nodes, entries), path)
    tracks = readers.collection_xml(spark, path).select(F.lit("track").alias("kind"), "name", F.col("trackid").alias("key"), F.lit(None).cast("long").alias("place"))
    found, listed = tree_document.read_tree(spark, path, 4)
    names = found.select("node", "name")
    listed = listed.join(names, "node").select(F.lit("entry").alias("kind"), "name", F.col("key").cast("long").alias("key"), F.col("place").cast("long").alias("place"))
    below = found.where("NOT folder").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("place"))
    nations = nation_names(found).join(below, "node", "left").select(F.lit("folder").alias("kind"), "name", F.lit(None).cast("long").alias("key"), F.coalesce("place", F.lit(0)).alias("place"))
    return tracks.unionByName(listed).unionByName(nations)


def nation_names(found: DataFrame) -> DataFrame:
    """Folders of the second level below the top."""
    return found.where("folder AND size(split(node, '[.]')) = 3").select("node", "name")

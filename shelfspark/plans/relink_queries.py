"""Entries matched to files by all steps, over rows made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import relinking
from shelfspark.plans.queries import query, table

# Expressions that both engines read. Entries and files come from orders; every third has its path, others share names, folders, lengths, audio or tracks.
ENTRY = {
    "entry": "o_orderkey",
    "path": "concat('C:\\\\Music\\\\F', o_orderkey % 97, '\\\\', CASE WHEN o_orderkey % 3 = 0 THEN concat('Ünter ', o_orderkey) WHEN o_orderkey % 3 = 1 THEN concat('name ', o_orderkey % 400) ELSE concat('other ', o_orderkey) END, '.mp3')",
    "title": "concat('title ', o_orderkey % 11)",
    "total_s": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 300 END",
}
FILE = {
    "file": "o_orderkey",
    "path": "CASE WHEN o_orderkey % 6 = 0 THEN concat('c:/music/f', o_orderkey % 97, '/üNTER ', o_orderkey, '.MP3') ELSE concat('D:/new/g', o_orderkey % 53, '/name ', o_orderkey % 800, '.mp3') END",
    "duration_ms": "o_custkey % 300 * 1000 + o_orderkey % 700",
    "audio": "CASE WHEN o_orderkey % 5 = 0 THEN concat('a', o_orderkey) END",
    "track": "CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END",
}
TITLES = "concat('title ', o_orderkey % 11)"
FILES_WHERE = "o_orderkey % 13 <> 1"
CONFIRMED = {"entry": "o_orderkey", "file": "o_orderkey + 1", "audio": "CASE WHEN o_orderkey % 2 = 0 THEN concat('a', o_orderkey + 1) ELSE 'x' END"}
REJECTED = {"entry": "o_orderkey", "audio": "concat('a', o_orderkey)"}
GONE = {"path": ENTRY["path"], "audio": "CASE WHEN o_orderkey % 5 = 0 THEN concat('a', o_orderkey) END", "track": "CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END", "duration_ms": "o_custkey % 300 * 1000 + o_orderkey % 3000"}
ALIKE = {"path": ENTRY["path"], "file": "o_orderkey"}
WHERE = {"confirmed": "o_orderkey % 71 = 0", "rejected": "o_orderkey % 35 = 0", "gone": "o_orderkey % 3 = 2", "alike": "o_orderkey % 11 = 2 AND o_orderkey % 3 = 2"}


def _inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    orders = table(spark, sf_dir, "orders")
    made = lambda columns: [F.expr(e).alias(c) for c, e in columns.items()]
    files = orders.where(FILES_WHERE).select(*made(FILE), F.array(F.expr(TITLES)).alias("titles"))
    others = [orders.where(WHERE[n]).select(*made(c)) for n, c in (("confirmed", CONFIRMED), ("rejected", REJECTED), ("gone", GONE), ("alike", ALIKE))]
    return [orders.select(*made(ENTRY)), files, *others]


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items()).replace("\\\\", "\\")


KEY = "upper(replace(path, chr(92), '/'))"
FITS = "f.duration_ms >= e.total_s * 1000 - 500 AND f.duration_ms < e.total_s * 1000 + 1500"


def _clear(n: int, pairs: str) -> str:
    return f"p{n} AS MATERIALIZED (SELECT DISTINCT entry, file FROM ({pairs})), k{n} AS (SELECT entry, file FROM p{n} WHERE entry IN (SELECT entry FROM p{n} GROUP BY 1 HAVING count(*) = 1) AND file IN (SELECT file FROM p{n} GROUP BY 1 HAVING count(*) = 1) AND file NOT IN (SELECT file FROM m{n - 1}))"


def _add(n: int, method: str, confidence: str, probable: str) -> str:
    """Matches of step n that are not refused, put to those before."""
    found = f"SELECT k.entry, k.file, '{method}' AS method, ({confidence})::DOUBLE AS confidence, {probable} AS probable FROM k{n} k JOIN fs f ON f.file = k.file JOIN es e ON e.entry = k.entry WHERE NOT EXISTS (SELECT 1 FROM rj WHERE rj.entry = k.entry AND rj.audio = f.audio)"
    return f"m{n} AS MATERIALIZED (SELECT * FROM m{n - 1} UNION ALL {found})"


AGREES = "e.title = f.t"
STEPS = ", ".join(
    [
        f"es AS MATERIALIZED (SELECT *, regexp_extract(key, '[^/]*$') AS name, regexp_extract(key, '^(.*)/', 1) AS folder FROM (SELECT *, {KEY} AS key FROM (SELECT {_list(ENTRY)} FROM orders)))",
        f"fs AS MATERIALIZED (SELECT *, regexp_extract(key, '[^/]*$') AS name, regexp_extract(key, '^(.*)/', 1) AS folder FROM (SELECT *, {KEY} AS key FROM (SELECT {_list(FILE)}, {TITLES} AS t FROM orders WHERE {FILES_WHERE})))",
        f"cf AS (SELECT {_list(CONFIRMED)} FROM orders WHERE {WHERE['confirmed']}), rj AS (SELECT {_list(REJECTED)} FROM orders WHERE {WHERE['rejected']})",
        f"gn AS (SELECT *, {KEY} AS key FROM (SELECT {_list(GONE)} FROM orders WHERE {WHERE['gone']})), al AS (SELECT DISTINCT {KEY} AS key, file FROM (SELECT {_list(ALIKE)} FROM orders WHERE {WHERE['alike']}))",
        "m0 AS MATERIALIZED (SELECT cf.entry, cf.file, 'user' AS method, CASE WHEN coalesce(cf.audio <> f.audio, false) THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, coalesce(cf.audio <> f.audio, false) AS probable FROM cf JOIN fs f USING (file) JOIN es USING (entry))",
        "m1 AS MATERIALIZED (SELECT * FROM m0 UNION ALL SELECT e.entry, min(f.file), 'path', 1.0, false FROM es e JOIN fs f USING (key) WHERE e.entry NOT IN (SELECT entry FROM m0) GROUP BY e.entry HAVING count(*) = 1)",
        _clear(2, f"SELECT e.entry, f.file FROM es e JOIN fs f USING (name) WHERE {FITS} AND e.entry NOT IN (SELECT entry FROM m1)"),
        _add(2, "filename_duration", "0.9", "false"),
        "pl AS MATERIALIZED (SELECT e.folder, f.folder AS place FROM m2 JOIN es e USING (entry) JOIN fs f USING (file) WHERE NOT probable UNION SELECT folder, folder FROM es WHERE total_s IS NOT NULL AND entry NOT IN (SELECT entry FROM m2))",
        "sm AS (SELECT pl.folder FROM pl JOIN fs f ON f.folder = place GROUP BY 1 HAVING count(*) <= 50)",
        _clear(3, f"SELECT e.entry, f.file FROM es e JOIN pl USING (folder) JOIN fs f ON f.folder = place WHERE {FITS} AND e.folder IN (SELECT folder FROM sm) AND e.entry NOT IN (SELECT entry FROM m2)"),
        _add(3, "unique_duration", f"CASE WHEN {AGREES} THEN 0.8 ELSE 0.4 END", f"NOT ({AGREES})"),
        _clear(4, "SELECT e.entry, f.file FROM es e JOIN gn g USING (key) JOIN fs f ON f.audio = g.audio WHERE e.entry NOT IN (SELECT entry FROM m3)"),
        _add(4, "fingerprint", "0.95", "false"),
        _clear(5, "SELECT e.entry, f.file FROM es e JOIN gn g USING (key) JOIN fs f ON f.track = g.track WHERE abs(g.duration_ms - f.duration_ms) <= 1000 AND e.entry NOT IN (SELECT entry FROM m4)"),
        _add(5, "fingerprint", f"CASE WHEN {AGREES} THEN 0.9 ELSE 0.4 END", f"NOT ({AGREES})"),
        _clear(6, "SELECT e.entry, f.file FROM es e JOIN gn g USING (key) JOIN al USING (key) JOIN fs f ON f.file = al.file WHERE abs(g.duration_ms - f.duration_ms) <= 1000 AND e.entry NOT IN (SELECT entry FROM m5)"),
        _add(6, "fingerprint", f"CASE WHEN {AGREES} THEN 0.85 ELSE 0.4 END", f"NOT ({AGREES})"),
        f"o7 AS (SELECT * FROM es WHERE entry NOT IN (SELECT entry FROM m6)), {_clear(7, f'SELECT e.entry, f.file FROM o7 e JOIN fs f USING (name) WHERE (e.total_s IS NULL OR ({FITS})) AND name IN (SELECT name FROM o7 GROUP BY 1 HAVING count(*) = 1)')}",
        _add(7, "filename_only", "0.5", "true"),
    ]
)


@query(f"WITH {STEPS} SELECT * FROM m7")
def relink_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed, path, name and length, the only length of a folder, the gone file's audio, track and likeness, and the name alone."""
    return relinking.relink_steps(*_inputs(spark, sf_dir))


@query(f"WITH {STEPS} SELECT method, count(*) FILTER (NOT probable) AS sure, count(*) FILTER (probable) AS doubtful FROM m7 GROUP BY 1")
def relink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relinking.match_counts(relinking.relink_steps(*_inputs(spark, sf_dir)))

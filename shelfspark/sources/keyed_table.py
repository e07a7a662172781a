"""A derived table that is kept current: a snapshot and deltas under a manifest, read as one table.

    table/data/<name>      Parquet of a snapshot or a delta
    table/manifest/v=N     what version N consists of

A version exists once its manifest is there, and a manifest is written last, after its
data. A write that fails leaves data that nothing refers to, and readers stay with the
version before. Versions are never changed, so a reader keeps what it has planned.
One writer at a time is assumed; of two, the later finds its version taken and fails.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.storage import remove, stored

MANIFEST = "kind string, path string, n int, source string, batch long"
GONE, TURN = "gone__", "turn__"


class KeyedTable:
    """Rows by key. ``columns`` is the table's schema (DDL or StructType), the key's columns included."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], columns):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.schema = spark.createDataFrame([], columns).schema
        self.names = self.schema.names

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST + ", v long").json(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def manifest(self, version: int | None = None) -> tuple[int, list[dict]]:
        """(version, its parts), the newest unless one is given; (0, []) of a table not yet written."""
        all_of = self._manifests()
        if all_of is None:
            return 0, []
        newest = all_of.agg(F.max("v")).first()[0] or 0
        at = newest if version is None else version
        rows = [r.asDict() for r in all_of.where(F.col("v") == at).drop("v").orderBy("n").collect()]  # a row for each part, few after compaction
        if version is not None and not rows:
            raise ValueError(f"no version {version} of {self.path}")
        return at, rows

    def _commit(self, version: int, parts: list[dict]) -> int:
        rows = self.spark.createDataFrame([tuple(p[c] for c in ("kind", "path", "n", "source", "batch")) for p in parts], MANIFEST)
        rows.coalesce(1).write.mode("error").json(f"{self.path}/manifest/v={version}")
        return version

    def _write(self, rows: DataFrame) -> str:
        at = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{at}")
        return at

    def _read(self, part: dict, extra: str = "") -> DataFrame:
        return self.spark.read.schema(f"{self.schema.toDDL()}{extra}").parquet(f"{self.path}/{part['path']}")

    def replace(self, rows: DataFrame, order: Column | None = None, source: str | None = None, batch: int | None = None) -> int:
        """Make ``rows`` the whole table: all of them or, if this fails, none. Of rows with one key the last by ``order`` stays."""
        version, parts = self.manifest()
        snapshot = {"kind": "snapshot", "path": self._write(self._last(rows, order).select(*self.names)), "n": 0, "source": None, "batch": None}
        return self._commit(version + 1, [snapshot, *self._applied(parts, source, batch)])

    def upsert(self, changes: DataFrame, order: Column | None = None, gone: Column | None = None, source: str | None = None, batch: int | None = None) -> int:
        """Add a delta: rows by key replace older ones; where ``gone`` holds, the key's row goes.

        Of several changes of one key the last by ``order`` counts. A batch of a source that
        was applied before changes nothing, so a stream may send it again after a failure.
        """
        version, parts = self.manifest()
        if source is not None and any(p["source"] == source and p["batch"] is not None and p["batch"] >= batch for p in parts):
            return version
        marked = changes.withColumn(GONE, F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
        delta = {"kind": "delta", "path": self._write(self._last(marked, order).select(*self.names, GONE)), "n": version + 1, "source": None, "batch": None}
        return self._commit(version + 1, [*(p for p in parts if p["kind"] != "source"), delta, *self._applied(parts, source, batch)])

    def _applied(self, parts: list[dict], source: str | None, batch: int | None) -> list[dict]:
        others = [p for p in parts if p["kind"] == "source" and p["source"] != source]
        return others + ([{"kind": "source", "path": None, "n": -1, "source": source, "batch": batch}] if source is not None else [])

    def _last(self, rows: DataFrame, order: Column | None) -> DataFrame:
        if order is None:
            return rows.dropDuplicates(self.key)
        rest = [c for c in rows.columns if c not in self.key]
        best = rows.withColumn(TURN, order).groupBy(*self.key).agg(F.max_by(F.struct(*rest) if rest else F.lit(True), TURN).alias("row__"))
        return best.select(*self.key, *(F.col(f"row__.{c}").alias(c) for c in rest))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as one: a snapshot's rows that no delta names, and each key's newest row of the deltas.

        The snapshot is not shuffled: it is joined against the deltas' keys, which Spark
        broadcasts while they are few; ``compact`` keeps them so.
        """
        _, parts = self.manifest(version)
        empty = self.spark.createDataFrame([], self.schema)
        snapshots = [self._read(p) for p in parts if p["kind"] == "snapshot"]
        base = snapshots[0] if snapshots else empty
        deltas = [self._read(p, f", {GONE} boolean").withColumn(TURN, F.lit(p["n"])) for p in parts if p["kind"] == "delta"]
        if not deltas:
            return base
        changes = reduce(DataFrame.unionByName, deltas)
        if len(deltas) > 1:
            newest = Window.partitionBy(*self.key).orderBy(F.desc(TURN))  # one row of a key in each delta
            changes = changes.withColumn("place__", F.row_number().over(newest)).where("place__ = 1")
        a, b = base.alias("a"), changes.select(*self.key).alias("b")
        same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.key])
        return a.join(b, same, "left_anti").select(*self.names).unionByName(changes.where(~F.col(GONE)).select(*self.names))

    def sync(self, derived: DataFrame, source: str | None = None, batch: int | None = None) -> DataFrame:
        """Bring the table to ``derived`` by writing the rows that differ and no others; (key, change) of every row.

        ``change`` is new, changed, gone or same. Returned rows do not depend on the write.
        """
        now, rest = self.read(), [c for c in self.names if c not in self.key]
        a = now.select(*(F.col(k).alias(f"a_{k}") for k in self.key), F.struct(*rest, F.lit(1).alias("one")).alias("old"))
        b = derived.select(*self.key, F.struct(*rest, F.lit(1).alias("one")).alias("new"))
        met = reduce(lambda x, y: x & y, [F.col(f"a_{k}").eqNullSafe(F.col(k)) for k in self.key])
        state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
        found = a.join(b, met, "full").select(*(F.when(F.col("new").isNull(), F.col(f"a_{k}")).otherwise(F.col(k)).alias(k) for k in self.key), "new", state.alias("change"))
        found = stored(found, "keyed-sync")
        moved = found.where("change <> 'same'").select(*self.key, *(F.col(f"new.{c}").alias(c) for c in rest), "change")
        self.upsert(moved, gone=F.col("change") == "gone", source=source, batch=batch)
        return found.select(*self.key, "change")

    def compact(self) -> int:
        """Write the newest version as one snapshot."""
        version, parts = self.manifest()
        if not any(p["kind"] == "delta" for p in parts):
            return version
        snapshot = {"kind": "snapshot", "path": self._write(self.read()), "n": 0, "source": None, "batch": None}
        return self._commit(version + 1, [snapshot, *(p for p in parts if p["kind"] == "source")])

    def vacuum(self, keep: int = 1) -> None:
        """Delete manifests but the newest ``keep`` ones, and data that no manifest left names."""
        all_of = self._manifests()
        if all_of is None:
            return
        versions = sorted((r.v for r in all_of.select("v").distinct().collect()), reverse=True)
        gone, kept = versions[keep:], versions[:keep]
        parts = {r.path: r.kept for r in all_of.where("path is not null").groupBy("path").agg(F.max(F.col("v").isin(kept)).alias("kept")).collect()}
        remove(self.spark, *(f"{self.path}/manifest/v={v}" for v in gone), *(f"{self.path}/{p}" for p, used in parts.items() if not used))

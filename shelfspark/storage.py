"""Tables that must outlive the executor which made them.

Lineage is cut by writing Parquet below the folder that the cluster names in
``spark.checkpoint.dir``. A folder of this machine is used only where that
setting is absent and Spark runs in local mode, as in tests.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Lists of the paths made inside ``scratch`` blocks that are open.
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shelfspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _scratch:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end what was written to new paths inside; results must have been written or collected by then.

    The paths are yielded as they come; take out of the list what is to stay.
    """
    made: list[str] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch[:] = [x for x in _scratch if x is not made]
        remove(spark, *made)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, without its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Let Arrow batches of whole texts hold fewer rows than Spark's 10,000, unless the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders, wherever Spark keeps them; those that are not there are left out."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfspark.streaming import bursts

T0 = datetime(2024, 1, 1)


def test_split():
    closed, state = bursts.split_bursts([0, 1, 2, 10, 11], None)
    assert closed == [(0, 2, 3, True)] and state[2] == 2
    closed, _ = bursts.split_bursts([float(k) for k in range(0, 200)], None)
    assert [(n, calm) for _, _, n, calm in closed] == [(60, False), (120, False)]  # the cap doubles


def test_stream(spark, tmp_path):
    seconds = [0, 1, 2, 20, 21, 100]
    rows = [("a", T0 + timedelta(seconds=s)) for s in seconds] + [("b", T0), ("a", T0 + timedelta(seconds=500)), ("z", T0 + timedelta(seconds=900))]
    schema = "root string, ts timestamp"
    for k, part in enumerate((rows[:3], rows[3:7], rows[7:], [("z", T0 + timedelta(seconds=2000))])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = bursts.bursts(stream).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.root, r.events) for r in spark.table("bursts").collect())
    assert set(got) >= {("a", 3), ("a", 2), ("a", 1)}


def test_session_windows_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    out = bursts.sessions(stream, "user_id", "ts", "12 hours")
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = bursts.sessions(events, "user_id", "ts", "12 hours")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("windows")) == key(batch)


def test_incremental_equals_rebuilt(spark, tmp_path):
    schema = "id long"
    base = spark.range(20).withColumn("v", F.col("id") * 2)
    for part in ([(1,), (2,)], [(2,), (3,)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = bursts.keep_current(stream, lambda due: due.join(base, "id"), "id", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, bursts.current(rows, "id").collect())) == [(1, 2), (2, 4), (3, 6)]

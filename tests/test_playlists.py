from shelfspark.operators import playlists


def test_what_the_timeline_uses_often_is_worked_out_once(spark):
    rows = spark.createDataFrame([(1, 1, 5, 1000, 120.0, 4, 3), (1, 2, 6, 2000, 124.0, 6, 9), (1, 3, 7, None, None, 9, None)], "playlist_id long, position long, recording_id long, time_ms long, bpm double, key_order int, energy int")
    df = playlists.timeline(rows, [(0.0, 3.0), (1.0, 5.0)])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min") == 1 and plan.count("Window [") == 1
    assert [tuple(r)[3:] for r in df.orderBy("position").collect()] == [(0, 3.0, "fine", "fine", "clash"), (1000, 4.0, "clash", "unknown", "unknown"), (3000, 5.0, None, None, None)]

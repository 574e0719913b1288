from pyspark.sql import functions as F

from roamframe.stops.grid import grid_stops
from roamframe.streaming import pings as stream


def _run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _source(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "user_id long, s long, location_id string").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_stop_stream_equals_batch(spark, tmp_path):
    rows = [(u, u * 7 + i * 120, "ab"[(i // 5) % 2]) for u in (1, 2) for i in range(40)]
    # Late enough to close what came before, itself no stop.
    rows += [(u, 10_000_000, "z") for u in (1, 2)]
    got = _run(spark, stream.grid_stop_stream(_source(spark, tmp_path, rows), 30, 2, 5), "stop_stream")
    batch = grid_stops(spark.createDataFrame(rows, "user_id long, timestamp long, location_id string"), 30, 2, 5)
    cols = ["user_id", "start_timestamp", "end_timestamp", "n_pings", "location_id", "duration"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_downsample_and_coverage_stream(spark, tmp_path):
    rows = [(1, i * 600, "a") for i in range(30)] + [(1, 10_000_000, "a")]
    src = _source(spark, tmp_path, rows)
    assert _run(spark, stream.downsample_stream(src, 3600), "down_stream").count() == 6
    got = _run(spark, stream.coverage_stream(src), "coverage_stream").collect()
    assert [(r.n_buckets, r.n_pings) for r in got if r.window.start.year == 1970 and r.window.start.month == 1][:1] == [(5, 30)]
    assert _run(spark, stream.session_stream(src), "session_stream").count() >= 1

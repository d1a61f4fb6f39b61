from pyspark.sql import functions as F

from tracelet.streaming import tracker

SCHEMA = "track long, frame long, score double"


def streamed(spark, files, tmp_path, name):
    """What the stream gives for files read one at a time, and how many late rows it counts."""
    src = tmp_path / name
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src / f"f{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    q = tracker.smooth_stream(stream, 2).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(300)
        return sorted(tuple(r) for r in spark.sql(f"select * from {name}").collect()), tracker.late_rows(q)
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(t, f, float((t * 7 + f * 3) % 10)) for t in (1, 2) for f in range(12)] + [(1, 5, 4.0)]
    files = [[r for r in rows if r[1] // 4 == k] for k in range(3)] + [[(9, 100, 0.0)]]  # a later frame flushes the others
    got, late = streamed(spark, files, tmp_path, "smoothed")
    want = sorted(tuple(r) for r in tracker.smooth_batch(spark.createDataFrame(rows, SCHEMA), 2).collect())
    assert got == want and len(got) == 25 and late == 0
    assert streamed(spark, files, tmp_path, "replayed") == (got, 0)


def test_late_rows_are_counted(spark, tmp_path):
    files = [[(1, f, 1.0) for f in range(10)], [(1, 100, 0.0)], [(1, 3, 50.0)], [(1, 200, 0.0)]]
    got, late = streamed(spark, files, tmp_path, "late")
    assert [r[1] for r in got] == [*range(10), 100] and all(r[3] == 1.0 for r in got[:10]) and late == 5


def test_tumbling_window_plan(spark):
    e = spark.createDataFrame([(1, 0.5), (3700, 1.5)], "s long, value double").select(F.timestamp_seconds("s").alias("ts"), F.lit("a").alias("event_type"), "value")
    assert tracker.divisions_by_window(e, "1 hour", "1 minute").count() == 2

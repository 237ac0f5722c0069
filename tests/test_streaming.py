from pyspark.sql import functions as F

from tidemark.streaming import folds


def stream(spark, tmp_path, schema, *batches):
    """A stream whose batches are written as files in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def drained(spark, df, tmp_path, mode="append"):
    name = f"out_{abs(hash(str(tmp_path)))}"
    run = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).collect()


def test_windows_keep_their_state(spark, tmp_path):
    df = stream(spark, tmp_path, "client string, at_ms long, seq long", [("a", 0, 1), ("a", 5, 2)], [("a", 9, 3), ("b", 9, 4)], [("a", 10, 5)])
    got = {r.seq: (r.n, r.allowed) for r in drained(spark, folds.anchored_counts(df, 10, 2), tmp_path)}
    assert got == {1: (1, True), 2: (2, True), 3: (3, False), 4: (1, True), 5: (1, True)}


def test_first_writers(spark, tmp_path):
    rows = [("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:10:00", 2), ("j", "2024-01-01 00:10:00", 3)]
    df = stream(spark, tmp_path, "k string, t string, n int", rows[:1], rows[1:]).withColumn("t", F.to_timestamp("t"))
    assert {(r.k, r.n) for r in drained(spark, folds.first_writers(df, "k", "t", "1 day"), tmp_path)} == {("k", 1), ("j", 3)}


def test_totals_and_windows(spark, tmp_path):
    df = stream(spark, tmp_path / "a", "domain string, saved long, hit boolean", [("x", 5, True)], [("x", -1, False), ("y", None, None)])
    got = {r.domain: (r.saved, r.hits, r.misses) for r in drained(spark, folds.running_totals(df), tmp_path / "a", "complete")}
    assert got == {"x": (5, 1, 1), "y": (0, 0, 0)}
    df = stream(spark, tmp_path / "b", "ts timestamp_ntz, event_type string", *[[(__import__("datetime").datetime(2024, 1, 1, h), "view")] for h in (0, 0, 1)])
    got = {(r.start.hour, r.n) for r in drained(spark, folds.timed_counts(df), tmp_path / "b", "update")}
    assert (0, 2) in got and (1, 1) in got

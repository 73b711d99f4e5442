from pyspark.sql import functions as F

from searchloom.streaming import incremental

SCHEMA = "id long, ts timestamp, kind string"


def batch(spark, rows, path):
    frame = spark.createDataFrame(rows, "id long, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    frame.write.mode("append").parquet(path)


def test_ingest_adds_each_key_once(spark, tmp_path):
    inbox, target, state = (str(tmp_path / n) for n in ("inbox", "target", "state"))
    batch(spark, [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:01:00", "b")], inbox)
    stream = incremental.file_stream(spark, inbox, SCHEMA)
    incremental.ingest(stream, target, "id", state).awaitTermination()
    batch(spark, [(2, "2024-01-01 00:01:00", "b"), (3, "2024-01-01 00:02:00", "c")], inbox)
    incremental.ingest(incremental.file_stream(spark, inbox, SCHEMA), target, "id", state).awaitTermination()
    # The same files again, as after a lost checkpoint, add nothing.
    incremental.ingest(incremental.file_stream(spark, inbox, SCHEMA), target, "id", state + "2").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_windows_and_late_rows(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    batch(spark, [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:05", "a"), (2, "2024-01-01 00:00:10", "a")], inbox)
    stream = incremental.deduplicated(incremental.file_stream(spark, inbox, SCHEMA), ["id"], "ts", "1 minute")
    query = stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.table("once").collect()) == [1, 2]
    counts = incremental.windowed_counts(incremental.file_stream(spark, inbox, SCHEMA), "ts", "kind", "1 minute", "1 minute")
    query = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["n"] for r in spark.table("counted").collect()] == [3]

"""Incremental ingestion: new rows of a stream, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within a bound of lateness; state older than it is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def ingest(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's rows whose key the target doesn't hold; a batch that
    is run again after a failure adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], batch.schema).write.mode("append").parquet(target)
        known = spark.read.schema(batch.schema).parquet(target).select(key)
        batch.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, group: str, width: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"))

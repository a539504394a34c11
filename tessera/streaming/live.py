"""Structured Streaming: the batch operators over tables that grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import yang


def stream_table(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """Files that arrive in a folder, with the schema of a known table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and key; state of windows older than the watermark goes."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("start"), key, "n", "value")
    )


def first_seen(events: DataFrame, key: str, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark: repeated records of a feed are dropped."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def watch_modules(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Parse module files as they arrive; ``handle`` gets the statements of a batch."""
    files = spark.readStream.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.yang")
    rows = files.select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.col("value").alias("text"))
    return rows.writeStream.foreachBatch(lambda df, n: handle(yang.statements(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

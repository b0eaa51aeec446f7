"""Streaming counterparts of the rollups: event time, watermark, late rows dropped.

Rows later than the watermark are dropped and counted in Spark's state metrics;
a replayed event_id within the watermark counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The table of that name, one file or a folder of them, and files that come later."""
    path = f"{folder}/{name}"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        rows = stream.parquet(path)
    else:  # a stream's path must be a folder
        rows = stream.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Of a stream or of a batch; in a batch every replayed event_id counts once."""
    rows = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Takes all that is there, writes finished windows to Parquet and stops."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

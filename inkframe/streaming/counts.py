"""The same transforms over streams: windowed character counts and per-type statistics with late data bounded.

An addition to the batch operators: state is kept by Spark's own windowed aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkframe.operators.text import characters


def read_stream(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, low, high) of event time windows; rows later than ``late`` are dropped by the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "low", "high")


def character_counts(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(characters(F.col("text"))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def run_once(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """All that there is now, batch by batch; a batch that ran before a failure isn't counted twice by an idempotent ``write``."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()

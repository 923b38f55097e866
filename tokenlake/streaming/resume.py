"""Incremental work as a stream: new shards in, each clip once, results appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def new_clips(spark: SparkSession, path: str, schema: T.StructType, *, per_trigger: int = 16) -> DataFrame:
    """A stream of the rows of new parquet shards in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def process_once(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, key: str = "audio_id") -> StreamingQuery:
    """Apply work to each key's first row and append the result; all that is there now, then stop. Calls resume."""
    return work(stream.dropDuplicates([key])).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

"""A folder of arriving files as a stream of batch loads.

Occurrence numbers are windows without time, which a streaming query cannot hold,
so each micro-batch is handed to the same batch functions as any other load; the
checkpoint remembers which files were read, and keys make a repeat harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(spark: SparkSession, folder: str, schema: str, load: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "csv", files_per_batch: int = 1) -> None:
    """Load all files that have arrived since the last call, oldest first, then stop."""
    stream = spark.readStream.format(fmt).schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, by, n over event time; for streams, rows later than ``late`` are dropped by the watermark."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")

"""Streams over a landing folder: the same expressions as in batches, with bounded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once_each(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are remembered until the watermark passes them."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(stream: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows in each window and group; windows close at the watermark."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")


def append_batches(stream: DataFrame, path: str, checkpoint: str, batch: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes all that has landed by now. A batch goes to a folder named by its number, so a repeated one replaces itself."""
    def write(df: DataFrame, number: int) -> None:
        (batch(df) if batch else df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Change events as a stream: appended files in, a callback or a running table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def change_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def on_change(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Call handler once for each batch of changes that has come in."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Rows of each key in windows of a width, dropped from the state once they are late by so much."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))

"""Resumable ingest: files once each, first rows of a key, windowed counts.

An extension: batch pipelines need none of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def keep_first(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key that comes within the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows by tumbling window and group, final once the watermark has passed."""
    grouped = stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def drain(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there to Parquet and stops; run again, it goes on where it was."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(out)

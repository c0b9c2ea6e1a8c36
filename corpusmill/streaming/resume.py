"""Incremental builds: new rows of a growing folder are appended once, by a stream with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def append_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Runs work over files that weren't seen before and appends its result to target; files are committed with the batch, so a stopped run repeats none."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = work(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    query.awaitTermination()

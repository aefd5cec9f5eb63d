"""Incremental loads: new files of a folder are derived and appended, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def enrich_available(spark: SparkSession, source: str, schema: str, derive: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Apply ``derive`` to the files that have come since the last run and append the result; returns when they are done."""
    stream = derive(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

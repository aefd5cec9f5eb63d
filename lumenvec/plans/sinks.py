"""Sinks: named-column appends, idempotent chunks and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_named(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("append").parquet(path)


def write_chunk(df: DataFrame, path: str, chunk: str) -> None:
    """Load a chunk once or again with the same effect: only its own partitions are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(path)


def delete_where(spark: SparkSession, path: str, new_path: str, predicate: str) -> None:
    """Rows for which the predicate isn't true, written to a new place."""
    spark.read.parquet(path).where(f"not coalesce({predicate}, false)").write.mode("overwrite").parquet(new_path)


def alter(spark: SparkSession, path: str, new_path: str, columns: dict[str, str]) -> None:
    """A copy of a table with columns added, or replaced where they are there, by SQL over the old ones."""
    spark.read.parquet(path).withColumns({name: F.expr(sql) for name, sql in columns.items()}).write.mode("overwrite").parquet(new_path)


def collapse(spark: SparkSession, path: str, new_path: str, keys: list[str], sums: list[str]) -> None:
    """A copy of a table with one row for each key, its other columns summed."""
    spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).write.mode("overwrite").parquet(new_path)

"""Loads that survive a crash: blocks are written aside and become visible by one atomic log entry; failed rows are patched in place."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Passes over chunks that failed.
PASSES = 6


def _files(spark: SparkSession, path: str):
    """Hadoop's file system for a path: whatever store Spark writes to."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs.Path


def token(df: DataFrame) -> str:
    """A name for the content of a block, whatever the order of its rows: their number and two sums of hashes."""
    rows = df.select(F.xxhash64(*df.columns).alias("a"), F.xxhash64(F.lit(7), *df.columns).alias("b"))
    n, a, b = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("a").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n}-{int(a) % 2**64:016x}{int(b) % 2**64:016x}"


def log(spark: SparkSession, path: str) -> list[dict]:
    """The entries of the load log, a small file for each visible block."""
    fs, Path = _files(spark, f"{path}/_log")
    if not fs.exists(Path(f"{path}/_log")):
        return []
    return [json.loads(r.value) for r in spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{path}/_log").collect()]


def load_block(df: DataFrame, path: str, block: str, before_log: Callable[[], None] | None = None) -> bool:
    """Load a block once: False if one with the same name and content is in the log.

    Rows go to a folder of the block's own, replacing what a load that died left there; the log entry, created only if it isn't there, makes
    them visible. So a load that dies between the two is picked up by the next, and of two at once one adds the entry. Another content under
    a name that is there is an error. ``before_log`` is called between the two steps.
    """
    spark = df.sparkSession
    mark = token(df)
    if known := [x for x in log(spark, path) if x["block"] == block]:
        if known[0]["token"] != mark:
            raise ValueError(f"block {block} was loaded with another content")
        return False
    folder = f"blocks/{block}-{mark}"
    df.write.mode("overwrite").parquet(f"{path}/{folder}")
    if before_log:
        before_log()
    fs, Path = _files(spark, path)
    name = "".join(c if c.isalnum() or c in "_-" else f"%{ord(c):x}" for c in block)
    try:
        out = fs.create(Path(f"{path}/_log/{name}.json"), False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(json.dumps({"block": block, "token": mark, "folder": folder, "rows": int(mark.split("-")[0])}).encode()))
    out.close()
    return True


def loaded(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all blocks in the log; others aren't seen."""
    folders = [f"{path}/{x['folder']}" for x in log(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def mop_up(spark: SparkSession, path: str, chunks: dict[str, Callable[[], DataFrame]], passes: int = PASSES) -> list[str]:
    """Load the chunks that the log misses, again and again up to ``passes`` times; the names of those that still fail.

    A chunk counts as loaded when its entry's rows are those that its block holds; one whose rows differ is dropped from the log and redone.
    """
    for _ in range(passes):
        good = set()
        for entry in log(spark, path):
            if spark.read.parquet(f"{path}/{entry['folder']}").count() == entry["rows"]:
                good.add(entry["block"])
            else:
                fs, Path = _files(spark, path)
                name = "".join(c if c.isalnum() or c in "_-" else f"%{ord(c):x}" for c in entry["block"])
                fs.delete(Path(f"{path}/_log/{name}.json"), False)
        missing = [c for c in chunks if c not in good]
        if not missing:
            return []
        for c in missing:
            try:
                load_block(chunks[c](), path, c)
            except Exception:  # what failed is tried in the next pass
                continue
    return [c for c in chunks if c not in {x["block"] for x in log(spark, path)}]


def patch(spark: SparkSession, path: str, partition: str, failed: str, recompute: Callable[[DataFrame], DataFrame], staging: str) -> list:
    """Recompute the rows for which the predicate ``failed`` holds and rewrite only the partitions that have some; these partitions' values.

    ``recompute`` gets the failed rows and returns rows of the same columns. The new partitions are written to ``staging`` first, from the
    table as it is, and then take the place of the old ones; files of other partitions stay as they are. Partitions, of which a list of
    values goes to the driver, are as many as folders.
    """
    table = spark.read.parquet(path)
    touched = [r[0] for r in table.where(failed).select(partition).distinct().collect()]
    if not touched:
        return []
    inside = F.col(partition).isin([t for t in touched if t is not None])
    part = table.where(inside | F.col(partition).isNull() if None in touched else inside)
    bad = F.coalesce(F.expr(failed), F.lit(False))
    part.where(~bad).unionByName(recompute(part.where(bad)).select(*table.columns)).write.mode("overwrite").parquet(staging)
    spark.read.schema(table.schema).parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return touched

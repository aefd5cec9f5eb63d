"""Shared pieces of the operators: scratch tables, safe column names, bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of at most so many rows may be broadcast; the row count is measured first.
BROADCAST_ROWS = 200_000

_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; in a local session that names none, one of our own. A cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if (now := sc._jsc.sc().getCheckpointDir()).isDefined():
        return now.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='lumenvec-')}"
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted by ``clear_scratch`` or when the driver's Python ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for df in tables:
        for spark, path in [x for x in _SCRATCH if any(x[1] in f for f in df.inputFiles()[:1])]:
            _delete(spark, path)
            _SCRATCH.remove((spark, path))


def clear_scratch() -> None:
    """Delete every table that ``materialize`` wrote; results not yet computed from them become unreadable."""
    while _SCRATCH:
        _delete(*_SCRATCH.pop())


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def free_driver(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans of many joins and small broadcasts leave some, which its JVM otherwise keeps as heap for good."""
    spark.sparkContext._jvm.System.gc()


def _at_exit() -> None:
    try:
        clear_scratch()
    except Exception:  # the JVM may be gone
        pass


atexit.register(_at_exit)


#: Rows of an Arrow batch at most: texts are long, and a batch is held several times over between the JVM and Python.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ARROW_ROWS`` rows where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def maybe_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side that was counted and is within the bound; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= bound else df


#: A key is hot if it has more than one in so many rows; at most so many keys can be.
HOT_SHARE = 1_000


def hot_keys(counts: DataFrame, rows: int, n: str = "c") -> DataFrame:
    """The rows of ``counts`` with over 1 / ``HOT_SHARE`` of ``rows``; there are fewer than ``HOT_SHARE``, so they may be broadcast."""
    return counts.where(F.col(n) * HOT_SHARE > rows)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """Inner join where ``left`` has the hot keys ``hot`` and ``right`` has few rows a key: the hot ones' side is broadcast, the rest is shuffled."""
    hot = F.broadcast(hot.select(*on))
    kept = F.broadcast(right.join(hot, on, "left_semi"))
    return left.join(kept, on).unionByName(left.join(hot, on, "left_anti").join(right, on))


def python_tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for a stage whose time goes into Python: the session's number of shuffle partitions, and more where ``rows`` ask for it.

    A repartition by a given number isn't coalesced by its bytes, which say little about such a stage's time.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

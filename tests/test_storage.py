"""Z-ordered tiles, logged loads, patches and bucketed joins."""

import glob
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenvec import storage
from lumenvec.catalogue import QUERIES
from lumenvec.plans import loads, tiles

LINES = "/root/testdata/sf0.01"


def _key(x, y):
    return sum(((x >> i & 1) << 2 * (i - 1)) | ((y >> i & 1) << (2 * (i - 1) + 1)) for i in range(1, 32))


def test_intervals_hold_the_tile():
    r = np.random.default_rng(0)
    for most in (1, 4, 16):
        for _ in range(60):
            side = 1 << int(r.integers(2, 32))
            x, y = np.sort(r.integers(0, side, 2)), np.sort(r.integers(0, side, 2))
            box = (int(x[0]), int(x[1]), int(y[0]), int(y[1]))
            spans = tiles.intervals(*box, most)
            assert 0 < len(spans) <= most and all(a <= b for a, b in spans) and all(b[0] > a[1] + 1 for a, b in zip(spans, spans[1:], strict=False))
            points = [(int(r.integers(box[0], box[1] + 1)), int(r.integers(box[2], box[3] + 1))) for _ in range(30)] + [(box[0], box[2]), (box[1], box[3])]
            assert all(any(lo <= _key(*p) <= hi for lo, hi in spans) for p in points)
    assert tiles.intervals(5, 4, 0, 9) == [] and tiles.intervals(0, 2**32 - 1, 0, 2**32 - 1) == [(0, 4**31 - 1)]
    wide, close = (sum(b - a for a, b in tiles.intervals(3 << 20, 5 << 20, 7 << 20, 9 << 20, most)) for most in (1, 16))
    assert close < wide / 10  # more intervals fit a tile closer


def test_tile_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "map")
    points = spark.range(200_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 32))).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 32))).alias("y"))
    tiles.write_map(points, path, files=4, group_bytes=1 << 16)
    box = (1 << 30, (1 << 30) + (1 << 28), 1 << 31, (1 << 31) + (1 << 28))
    tile = tiles.read_tile(spark, path, *box)
    want = points.where(F.col("x").between(*box[:2]) & F.col("y").between(*box[2:]))
    assert sorted(r.id for r in tile.collect()) == sorted(r.id for r in want.collect()) and tile.count() > 500
    spans, groups, met = tiles.intervals(*box), 0, 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("zkey")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            groups += 1
            met += any(lo <= s.max and hi >= s.min for lo, hi in spans)
    assert groups > 40 and met <= groups / 8
    leaf = tile._jdf.queryExecution().executedPlan().collectLeaves().head()
    tile._jdf.queryExecution().toRdd().count()
    assert leaf.metrics().apply("numOutputRows").value() < 200_000 / 8  # rows that leave the scan


def test_load_that_dies_before_its_entry(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).withColumn("x", F.lit("a"))

    def die():
        raise InterruptedError

    with pytest.raises(InterruptedError):
        loads.load_block(rows, path, "one", die)
    assert os.path.isdir(f"{path}/blocks") and loads.loaded(spark, path, rows.schema).count() == 0
    assert loads.load_block(rows, path, "one") and not loads.load_block(rows.orderBy(F.desc("id")), path, "one")
    assert loads.load_block(rows.limit(0), path, "empty/../name") and loads.loaded(spark, path, rows.schema).count() == 100
    with pytest.raises(ValueError):
        loads.load_block(rows.limit(5), path, "one")
    assert loads.token(rows) == loads.token(rows.repartition(7)) != loads.token(rows.withColumn("x", F.lit("b")))


def test_two_loads_at_once_add_one_entry(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10)
    assert not loads.load_block(rows, path, "b", lambda: loads.load_block(rows, path, "b"))
    assert loads.loaded(spark, path, rows.schema).count() == 10 and len(loads.log(spark, path)) == 1


def test_mop_up_passes(spark, tmp_path):
    path, tries = str(tmp_path / "t"), {"a": 0, "b": 0, "never": 0}

    def chunk(name, fails):
        def rows():
            tries[name] += 1
            if tries[name] <= fails:
                raise ConnectionError
            return spark.range(5)

        return rows

    chunks = {"a": chunk("a", 0), "b": chunk("b", 2), "never": chunk("never", 99)}
    assert loads.mop_up(spark, path, chunks, passes=4) == ["never"] and tries == {"a": 1, "b": 3, "never": 4}
    [entry] = [x for x in loads.log(spark, path) if x["block"] == "a"]
    spark.range(3).write.mode("overwrite").parquet(f"{path}/{entry['folder']}")  # a block that lost rows is loaded again
    assert loads.mop_up(spark, path, {k: chunks[k] for k in "ab"}) == [] and loads.loaded(spark, path, "id long").count() == 10


def test_patch_keeps_untouched_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.when(F.col("id") == 2, None).otherwise(F.col("id") % 2).alias("ok"), F.when(F.col("id") % 10 < 9, F.col("id") % 10).alias("part")).withColumn("ok", F.when(F.col("part").isin(1, 2) | F.col("part").isNull(), F.col("ok")).otherwise(1)).write.partitionBy("part").parquet(path)
    names = lambda: {f.removeprefix(path) for f in glob.glob(f"{path}/*/*.parquet")}
    before = names()
    touched = loads.patch(spark, path, "part", "ok = 0", lambda rows: rows.withColumn("ok", F.lit(1).cast("long")), f"{path}-aside")
    kept = {f for f in before if not any(f"part={t if t is not None else '__HIVE_DEFAULT_PARTITION__'}/" in f for t in touched)}
    assert set(touched) == {2} and kept == before & names() and len(kept) < len(before)
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.where("ok = 0").count() == 0 and back.where("ok is null").count() == 1
    assert loads.patch(spark, path, "part", "ok = 0", lambda rows: rows, f"{path}-aside") == []


def test_bucketed_join_has_no_exchange(spark):
    joined = QUERIES["jn11_buckets"](spark, LINES)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == spark.read.parquet(f"{LINES}/lineitem.parquet").count()
    assert storage.bucketed(spark.range(10).withColumn("x", F.lit(None).cast("string")), "id", 4).count() == 10

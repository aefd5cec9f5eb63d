"""Binary vector files through the data source: round trips in many splits, pruning, failures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenvec.sources import vector_files as vf


def _rows(kind, n=1000):
    r = np.random.default_rng(0)
    if kind in ("fbin", "npy"):
        return [([float(x) for x in r.integers(-8, 9, 16) / 4],) for _ in range(n)]
    if kind in ("u8bin", "bvecs", "i8bin"):
        return [([float(x) for x in r.integers(-128 if kind == "i8bin" else 0, 128, 16)],) for _ in range(n)]
    lengths = [10] * n if kind == "truth" else r.integers(0, 30, n)
    return [([int(x) for x in r.integers(0, 1 << 31, k)], [float(x) / 4 for x in r.integers(0, 9, k)]) for k in lengths]


KINDS = ["fbin", "u8bin", "i8bin", "bvecs", "npy", "truth", "range_truth", "csr"]


@pytest.mark.parametrize("kind", KINDS)
def test_round_trip_in_splits(spark, tmp_path, kind):
    rows = _rows(kind)
    fields = vf.schema_of(kind).fields[1:]
    df = spark.createDataFrame(rows, StructType(fields)).coalesce(1)
    path = str(tmp_path / kind)
    vf.write_vector_files(df, path, kind)
    [file] = [f for f in os.listdir(path) if f.endswith(kind)]
    split = os.path.getsize(f"{path}/{file}") // 3 + 1000
    back = vf.read_vector_files(spark, path, kind, split_bytes=split)
    assert back.rdd.getNumPartitions() == 3
    assert [tuple(x) for x in back.orderBy("id").collect()] == [(i, *x) for i, x in enumerate(rows)]
    several = vf.read_vector_files(spark, f"file://{path}", kind, id_offset=100, split_bytes=2000)
    assert several.rdd.getNumPartitions() > 5
    some = several.where("id >= 900 and id < 950")
    assert [tuple(x) for x in some.orderBy("id").collect()] == [(i + 100, *rows[i]) for i in range(800, 850)]
    assert some.rdd.getNumPartitions() < several.rdd.getNumPartitions() / 2 and several.where("id = 1").count() == 0
    first = fields[0].name
    assert vf.read_vector_files(spark, path, kind, columns=[first]).columns == [first]
    assert vf.read_vector_files(spark, path, kind, columns=["id"]).agg(F.sum("id")).first()[0] == 999 * 500
    vf.write_vector_files(df.limit(3), path, kind)
    assert vf.read_vector_files(spark, path, kind).count() == 1003
    vf.write_vector_files(df.limit(2), path, kind, "overwrite")
    assert vf.read_vector_files(spark, path, kind).count() == 2 and len([f for f in os.listdir(path) if f.endswith(kind)]) == 1
    vf.write_vector_files(df.limit(0), path, kind, "overwrite")
    assert vf.read_vector_files(spark, path, kind).count() == 0


def test_reads_plain_files(spark, tmp_path):
    """Files of other programs: a single file, and a folder without a manifest, in the order of names."""
    a = np.arange(6, dtype="<f4").reshape(2, 3)
    for name, v in (("a.fbin", a), ("b.fbin", a + 10)):
        (tmp_path / name).write_bytes(np.array(v.shape, "<u4").tobytes() + v.tobytes())
    np.save(tmp_path / "x.npy", a.astype(np.float16))
    (tmp_path / "e.bvecs").write_bytes(b"")
    assert [x.vec for x in vf.read_vector_files(spark, str(tmp_path / "a.fbin"), "fbin").orderBy("id").collect()] == a.tolist()
    assert [(x.id, x.vec[0]) for x in vf.read_vector_files(spark, str(tmp_path), "fbin", id_offset=7).orderBy("id").collect()] == [(7, 0), (8, 3), (9, 10), (10, 13)]
    assert [x.vec for x in vf.read_vector_files(spark, str(tmp_path), "npy").orderBy("id").collect()] == a.tolist()
    assert vf.read_vector_files(spark, str(tmp_path), "bvecs").count() == 0
    (tmp_path / "a.fbin").write_bytes((tmp_path / "a.fbin").read_bytes()[:20])
    with pytest.raises(Exception):
        vf.read_vector_files(spark, str(tmp_path / "a.fbin"), "fbin").collect()


@pytest.mark.parametrize("bad", [[None], [1.5], [300.0], [1.0, 2.0]])
def test_failed_writes_leave_nothing(spark, tmp_path, bad):
    """One task fails after others wrote: no file and no row of the job stays, what was there before does."""
    path = str(tmp_path / "t")
    good = spark.createDataFrame([([1.0],)] * 8, "vec array<float>")
    vf.write_vector_files(good, path, "u8bin")
    before = sorted(os.listdir(path))
    worse = good.repartition(4).unionByName(spark.createDataFrame([([3.0],), (bad,)], "vec array<float>").coalesce(1))
    with pytest.raises(Exception):
        vf.write_vector_files(worse, path, "u8bin", file_bytes=1)
    assert sorted(os.listdir(path)) == before and vf.read_vector_files(spark, path, "u8bin").count() == 8


def test_killed_task_is_not_seen(spark, tmp_path):
    """A Python worker that dies after it wrote a file: the attempt's file is in no manifest, and the retried job's rows are there once."""
    path, flag = str(tmp_path / "t"), str(tmp_path / "flag")
    real = vf.encode

    def dies(batches):
        for b in batches:
            yield b
        if not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)

    rows = spark.range(0, 100, 1, 2).select(F.array(F.col("id").cast("float")).alias("vec")).mapInArrow(dies, "vec array<float>")
    try:
        vf.write_vector_files(rows, path, "fbin", file_bytes=1)
    except Exception:  # a local master does not retry tasks
        assert not os.path.exists(f"{path}/{vf.MANIFEST}")
        vf.write_vector_files(rows, path, "fbin", file_bytes=1)
    got = [x.vec[0] for x in vf.read_vector_files(spark, path, "fbin").collect()]
    assert sorted(got) == [float(i) for i in range(100)] and real is vf.encode

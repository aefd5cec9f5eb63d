"""Rotations, triplets, rank correlation, guards and carried positions against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec import representations as R
from lumenvec.catalogue import QUERIES, _asked, _pool
from lumenvec.evaluation import codes
from lumenvec.operators import gram, rotation, search

DATA = "/root/testdata/sf0.001"


def test_haar_rotation_keeps_lengths(spark):
    q = rotation.haar(6)
    assert np.allclose(q @ q.T, np.eye(6)) and not np.allclose(q, rotation.haar(6, 2))
    v = np.random.default_rng(0).normal(size=(20, 6))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, None), (21, [1.0])]
    got = rotation.rotate(spark.createDataFrame(rows, "key long, vec array<double>"), "vec", q).orderBy("key").collect()
    assert np.allclose([r.vec for r in got[:20]], v @ q.T) and got[20].vec is None and got[21].vec is None


def test_metrics_by_group(spark):
    r = np.random.default_rng(1)
    rows = [(c, q, k, float(np.round(r.normal(), 1)), float(np.round(r.normal(), 1))) for c in (0, 1) for q in (0, 10) for k in range(31)]
    met = spark.createDataFrame(rows, "cell int, qid int, key int, dist double, truth double").repartition(3)

    def ranks(x):
        return np.array([(np.sum(x < v) + np.sum(x <= v) + 1) / 2 for v in x])

    rsa = {x.cell: x.rsa for x in R.spearman(met, "cell", "dist", "truth").collect()}
    triplets = {x.cell: x.triplets for x in R.agreement(met, ["cell"]).collect()}
    for c in (0, 1):
        a, b = (np.array([x[k] for x in rows if x[0] == c]) for k in (3, 4))
        assert abs(rsa[c] - np.corrcoef(ranks(a), ranks(b))[0, 1]) < 1e-5
        held = {(x[1], x[2]): x[3:] for x in rows if x[0] == c}
        hits = [(held[q, k][0] < held[q, k + 1][0]) == (held[q, k][1] < held[q, k + 1][1]) for q in (0, 10) for k in range(0, 30, 2)]
        assert abs(triplets[c] - np.mean(hits)) < 1e-6
    x, y = r.normal(size=(2, 60, 4)), r.normal(size=(2, 60, 3))
    df = spark.createDataFrame([(g, x[g, i].tolist(), y[g, i].tolist()) for g in (0, 1) for i in range(60)], "g int, a array<double>, b array<double>").repartition(3)
    for row in gram.grouped_cka(df, "g", F.col("a"), F.col("b")).collect():
        u, v = (m[row.g] - m[row.g].mean(0) for m in (x, y))
        assert abs(row.cka - np.sum((u.T @ v) ** 2) / np.linalg.norm(u.T @ u) / np.linalg.norm(v.T @ v)) < 1e-9


def test_ablation_has_every_setting(spark):
    got = {(r.rotated, r.scale, r.bits): r for r in QUERIES["ve20_rotation_ablation"](spark, DATA).collect()}
    assert set(got) == {(t, s, b) for t in (True, False) for s in ("sphere", "fitted") for b in (1, 2, 4)}
    for (t, s, b), r in got.items():
        assert 0 < r.recall <= 1 and 0.5 < r.triplets <= 1 and 0 < r.rsa <= 1 and 0 < r.cka <= 1
        if b > 1:
            less = got[t, s, b // 2]
            assert r.rsa > less.rsa and r.cka > less.cka  # more bits keep more


def test_guard_fails_where_codes_are_skipped(spark, tmp_path):
    pool, asked = _pool(spark, DATA), _asked(spark, DATA)
    found, rows = R.guarded(pool, asked, 10, 5, codes(1), str(tmp_path / "a"))
    want = search.two_stage(pool, asked, 10, 5, codes(1))
    assert sorted(map(tuple, found.select("qid", "key", "rank").collect())) == sorted(map(tuple, want.select("qid", "key", "rank").collect()))
    assert rows[0][1] == rows[0][2] and rows[1][1] == 50 * asked.count()
    with pytest.raises(R.PathNotTaken):  # codes for a part of the pool only
        R.guarded(pool, asked, 10, 5, lambda p, q: codes(1)(p.where("key < 100"), q), str(tmp_path / "b"))
    with pytest.raises(R.PathNotTaken):  # the second stage scores every row again
        R.guarded(pool, asked, 10, 50, codes(1), str(tmp_path / "c"))


def test_carried_positions(spark):
    r = np.random.default_rng(4)
    v, at = r.normal(size=(40, 5)), r.normal(size=(40, 2))
    sample = [(i, v[i], at[i]) for i in range(0, 40, 4)]
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(40)] + [(99, [0.0] * 5)], "key long, vec array<double>").repartition(3)
    got = {x.key: (x.x, x.y) for x in R.carry(df, sample).collect()}
    assert set(got) == {*range(40), 99} and all(np.isfinite(p).all() for p in got.values())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(40):
        if i % 4 == 0:
            assert np.allclose(got[i], at[i])
        else:
            d = np.round(1 - u[::4] @ u[i], 9)
            near = np.lexsort((np.arange(10), d))[:5]
            w = 1 / (d[near] + 1e-6)
            assert np.allclose(got[i], (w[:, None] * at[::4][near]).sum(0) / w.sum())
    assert R.carry(df.limit(0), sample).count() == 0 and R.carry(df, sample[:2]).count() == 41
    fitted = QUERIES["mp10_fitted_positions"](spark, DATA).toPandas()
    assert len(fitted) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    some = R.sampled(spark, DATA).toPandas()
    m = np.stack(some.vec)
    axes = np.linalg.eigh(np.cov(m.T))[1][:, ::-1][:, :2]
    mine = fitted.set_index("key").loc[some.key][["x", "y"]].to_numpy()
    assert np.allclose(np.abs(mine), np.abs((m - m.mean(0)) @ axes), atol=1e-6)


def test_levels_are_near_the_best(spark):
    """Lloyd's levels on all coordinates: no level is off the mean of what it stands for, and the error falls with the bits."""
    x = np.concatenate([r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]).astype(float)
    got = QUERIES["ve16_sampled_codebook"](spark, DATA).toPandas()
    error = {}
    for bits, g in got.groupby("bits"):
        levels = g.sort_values("code").level.to_numpy()
        assert len(levels) == 1 << bits and (np.diff(levels) >= 0).all()
        cell = np.searchsorted((levels[1:] + levels[:-1]) / 2, x)
        error[bits] = np.mean((x - levels[cell]) ** 2)
        means = np.array([x[cell == k].mean() if (cell == k).any() else levels[k] for k in range(len(levels))])
        assert np.abs(means - levels).max() < 0.01
    assert error[1] > error[2] > error[3] > error[4] > error[8] and abs(error[1] / x.var() - 0.363) < 0.03

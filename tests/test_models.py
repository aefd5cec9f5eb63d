"""Stored fit states and mini-batch training against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec import models
from lumenvec.catalogue import QUERIES
from lumenvec.operators import fit_state as fs
from lumenvec.operators import sgd

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 5))
    y = (x @ [2, -1, 0.5, 0, 0] + r.normal(size=400) > 0.3).astype(int)
    w = r.integers(1, 4, 400).astype(float)
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i]), float(w[i])) for i in range(400)], "id long, x array<double>, y int, weight double").repartition(4), x, y, w


def test_states_of_two_loads_are_one_fit(spark, rows):
    df, x, y, w = rows
    whole = fs.fit_state(df, F.col("x"), F.col("y"), F.col("weight"))
    halves = [fs.fit_state(df.where(f"id % 2 = {k}"), F.col("x"), F.col("y"), F.col("weight")) for k in (0, 1)]
    z = np.column_stack([np.ones(400), x])
    want = np.linalg.solve((z * w[:, None]).T @ z, (z * w[:, None]).T @ y)
    for state in (whole, fs.merge(halves[0].unionByName(halves[1]))):
        assert np.allclose(fs.solve(state), want)
    grouped = fs.fit_state(df.withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3)), F.col("x"), F.col("y"), by=["g"])
    part = fs.matrix(grouped.where("g is null").drop("g"))
    m = np.column_stack([np.ones(134), x[::3], y[::3]])
    assert np.allclose(part, m.T @ m) and grouped.select("g").distinct().count() == 3
    step = np.linalg.solve((z * w[:, None]).T @ z, 4 * (z * w[:, None]).T @ (y - 0.5))
    assert np.allclose(fs.solve_logistic_step(whole), step)
    got = df.select("id", fs.probability(F.col("x"), step).alias("p")).orderBy("id").toPandas().p
    assert np.allclose(got, 1 / (1 + np.exp(-z @ step)))
    holes = df.unionByName(spark.createDataFrame([(1, None, 1, 1.0), (2, [0.0] * 5, None, 1.0)], df.schema))
    assert np.allclose(fs.matrix(fs.fit_state(holes, F.col("x"), F.col("y"), F.col("weight"))), fs.matrix(whole))
    assert fs.fit_state(df.limit(0), F.col("x"), F.col("y")).count() == 0 and fs.solve(whole, ridge=1e9)[1:].max() < 1e-5


SETTINGS = [sgd.Setting(0.1, 0.01, 4, "Adam"), sgd.Setting(0.5, 0.0, 4, "SGD"), sgd.Setting(0.1, 0.001, 2, "Momentum"), sgd.Setting(0.1, 0.0, 1, "Nesterov"), sgd.Setting(0.02, 0.1, 2, "Adam")]


def _by_hand(spark, path, setting, epochs, classes=1, finest=4):
    """One setting in plain numpy, over the same batches in the same order."""
    held = spark.read.parquet(path).toPandas()
    dim = len(held.x[0])
    w, m, v, t = np.zeros((classes, dim + 1)), 0.0, 0.0, 0
    for epoch in range(epochs):
        order = sgd.epoch_order(epoch, finest)
        for k in range(0, finest, finest // setting.batches):
            b = held[held.batch.isin(order[k : k + finest // setting.batches])]
            if not len(b):
                continue
            at = w - setting.rate * sgd.KEEP * m if setting.method == "Nesterov" else w
            z = np.column_stack([np.ones(len(b)), np.stack(b.x)])
            s = z @ at.T
            p = 1 / (1 + np.exp(-s)) if classes == 1 else np.exp(s) / np.exp(s).sum(1, keepdims=True)
            truth = (b.y.to_numpy()[:, None] == (np.arange(classes) if classes > 1 else [1])).astype(float)
            g = ((p - truth) * b.weight.to_numpy()[:, None]).T @ z / b.weight.sum()
            g[:, 1:] += setting.l2 * at[:, 1:]
            t += 1
            if setting.method == "Adam":
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - setting.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            elif setting.method == "SGD":
                w = w - setting.rate * g
            else:
                m = 0.9 * m + g
                w = w - setting.rate * m
    return w


def test_grid_is_each_setting_alone(spark, rows, tmp_path):
    df, x, y, _ = rows
    sgd.write_batches(df, f"{tmp_path}/b", 4)
    w = sgd.train(spark, f"{tmp_path}/b", SETTINGS, 5, 3, f"{tmp_path}/w")
    for k, s in enumerate(SETTINGS):
        assert np.allclose(w[k], _by_hand(spark, f"{tmp_path}/b", s, 3)), s
    p = df.select("y", F.get(sgd.scores(F.col("x"), w[1]), F.lit(0)).alias("p")).toPandas()
    assert ((p.p > 0.5) == (p.y == 1)).mean() > 0.85
    # a run that stopped after an epoch goes on as if it hadn't
    sgd.train(spark, f"{tmp_path}/b", SETTINGS, 5, 1, f"{tmp_path}/w2")
    assert np.allclose(sgd.train(spark, f"{tmp_path}/b", SETTINGS, 5, 3, f"{tmp_path}/w2"), w)
    assert spark.read.schema(sgd.WEIGHTS).parquet(f"{tmp_path}/w/epoch=2").count() == 5 * 6


def test_softmax_and_empty_batches(spark, rows, tmp_path):
    df, x, _, _ = rows
    three = df.withColumn("y", (F.pmod(F.floor(F.get("x", F.lit(0)) * 2), F.lit(3))).cast("int")).limit(40)
    sgd.write_batches(three, f"{tmp_path}/b", 64)
    s = sgd.Setting(0.3, 0.01, 64, "Adam")
    w = sgd.train(spark, f"{tmp_path}/b", [s], 5, 1, f"{tmp_path}/w", classes=3)[0]
    assert np.allclose(w, _by_hand(spark, f"{tmp_path}/b", s, 1, 3, 64))
    p = three.select("x", sgd.scores(F.col("x"), w).alias("p")).toPandas()
    z = np.column_stack([np.ones(len(p)), np.stack(p.x)]) @ w.T
    assert np.allclose(np.stack(p.p), np.exp(z) / np.exp(z).sum(1, keepdims=True))
    for bad in ([sgd.Setting(1, 0, 3, "SGD"), sgd.Setting(1, 0, 4, "SGD")], [sgd.Setting(1, 0, 4, "adagrad")]):
        with pytest.raises(ValueError):
            sgd.Optimiser(bad, 1, 2)


def test_report_counts(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(2, 0)] * 2
    got = {(r.truth, r.guess): r for r in models.report(spark.createDataFrame(pairs, "truth int, guess int").groupBy("truth", "guess").agg(F.count("*").alias("n"))).collect()}
    assert {k: r.n for k, r in got.items()} == {(0, 0): 5, (0, 1): 2, (1, 1): 3, (1, 0): 1, (2, 0): 2}
    f = {0: 2 * 5 / (7 + 8), 1: 2 * 3 / (4 + 5), 2: 0.0}
    for (t, _), r in got.items():
        assert abs(r.f1 - f[t]) < 1e-6 and abs(r.macro_f1 - sum(f.values()) / 3) < 1e-6
    assert got[2, 0].precision == 0 and abs(got[0, 1].precision - 5 / 8) < 1e-6 and abs(got[1, 0].recall - 3 / 4) < 1e-6


def test_queries_hold_out_a_quarter(spark):
    grid = QUERIES["ml07_sgd_grid"](spark, DATA).collect()
    assert len(grid) == 5 and len({r.n for r in grid}) == 1 and all(0 <= r.acc <= 1 and 0 < r.mean < 1 for r in grid)
    full = QUERIES["ml09_balanced_report"](spark, DATA).toPandas()
    split = models.softmax_split(spark, DATA)
    per = split.groupBy("y").agg(F.sum(F.col("train").cast("int")).alias("t"), F.count("*").alias("n")).collect()
    assert full.n.sum() == split.where("not train").count() and all(r.t == -(-3 * r.n // 4) for r in per)

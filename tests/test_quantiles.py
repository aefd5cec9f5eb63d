"""Quantiles against numpy; sketches within their rank error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.operators import quantiles as Q


@pytest.fixture(scope="module")
def values(spark):
    r = np.random.default_rng(0)
    v = {"wide": r.lognormal(0, 3, 20_000), "few": r.integers(0, 3, 9_000).astype(float), "same": np.full(8_000, 2.5), "one": np.array([7.0]), None: r.normal(size=5_000)}
    rows = [(g, float(x)) for g, xs in v.items() for x in xs] + [("wide", None), ("none", None), ("wide", float("nan"))]
    return spark.createDataFrame(rows, "g string, x double").repartition(6), v


@pytest.mark.parametrize("ordered", [1_000_000, 300])
def test_exact_quantiles_by_group(spark, values, ordered):
    df, v = values
    places = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0, "tenth": "floor(n / 10)"}
    got = {r.g: r for r in Q.quantiles(df, F.col("x"), places, ["g"], ordered).collect()}
    assert set(got) == {*v, "none"} and got["none"].p50 is None
    for g, x in v.items():
        want = [*np.quantile(x, [0, 0.01, 0.5, 0.99, 1]), np.sort(x)[len(x) // 10]]
        assert np.allclose([got[g][n] for n in places], want, rtol=1e-12), g
    everything = np.concatenate(list(v.values()))
    [r] = Q.quantiles(df, F.col("x"), {"q": 0.37}, ordered=ordered).collect()
    assert np.isclose(r.q, np.quantile(everything, 0.37), rtol=1e-12)
    assert Q.quantiles(df.limit(0), F.col("x"), {"q": 0.5}, ["g"]).count() == 0 and Q.quantiles(df.limit(0), F.col("x"), {"q": 0.5}).first().q is None


def test_sketches_merge_within_their_rank_error(spark, values, tmp_path):
    df, v = values
    Q.sketches(df, F.col("x"), ["g"]).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    everything = np.sort(np.concatenate(list(v.values())))
    ranks = {f"r{k}": k / 20 for k in range(1, 20)}
    for row, x in [(Q.approximate(Q.merged(stored), ranks).first(), everything), (Q.approximate(stored.where("g = 'wide'"), ranks).first(), np.sort(v["wide"]))]:
        for name, p in ranks.items():
            lo, hi = np.searchsorted(x, row[name], "left") / len(x), np.searchsorted(x, row[name], "right") / len(x)
            assert lo - Q.RANK_ERROR <= p <= hi + Q.RANK_ERROR

"""Fits as stored, mergeable states: weighted cross-products of (1, features, target), solved when they are applied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from lumenvec.functions import vec

STATE = "i int, j int, s double"


def fit_state(df: DataFrame, x: Column, y: Column, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., i, j, s): sums of weight * z[i] * z[j] over rows, i <= j, where z is 1, the features, then the target.

    Rows with a null in any of them take no part. A task sends one triangle for each group, so the shuffle grows with tasks and features, not
    with rows. States of two loads have the sum of both as their state (``merge``).
    """
    by = by or []
    rows = df.select(*by, x.cast("array<double>").alias("__x"), y.cast("double").alias("__y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("__w")).dropna(subset=["__x", "__y", "__w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [f.type for f in batch.schema][: len(by)]
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(by))], strict=True)) if by else [()] * batch.num_rows
            m = np.stack(batch.column(len(by)).to_numpy(zero_copy_only=False))
            z = np.column_stack([np.ones(len(m)), m, batch.column(len(by) + 1).to_numpy()])
            w = batch.column(len(by) + 2).to_numpy()
            at = {k: n for n, k in enumerate(dict.fromkeys(keys))}
            place = np.array([at[k] for k in keys])
            for key, n in at.items():
                mine = place == n
                sums[key] = sums.get(key, 0.0) + (z[mine] * w[mine, None]).T @ z[mine]
        for key, g in sums.items():
            i, j = np.triu_indices(len(g))
            columns = [pa.array([k] * len(i), t) for t, k in zip(types, key, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], [*by, "i", "j", "s"])

    shape = StructType([rows.schema[b] for b in by])
    for name, kind in (("i", IntegerType()), ("j", IntegerType()), ("s", DoubleType())):
        shape = shape.add(name, kind)
    return merge(rows.mapInArrow(run, shape), by)


def merge(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The state of all rows behind several states."""
    return states.groupBy(*(by or []), "i", "j").agg(F.sum("s").alias("s"))


def matrix(state: DataFrame) -> np.ndarray:
    """A state without groups as a symmetric matrix; the driver gets a number for each two features."""
    held = state.toPandas()
    side = int(held["j"].max()) + 1 if len(held) else 0
    g = np.zeros((side, side))
    g[held["i"], held["j"]] = g[held["j"], held["i"]] = held["s"]
    return g


def solve(state: DataFrame, ridge: float = 0.0) -> np.ndarray:
    """(intercept, weights) of least squares; ``ridge`` is added to the features' squares. Features that determine one another share a weight."""
    g = matrix(state)
    a = g[:-1, :-1] + ridge * np.diag([0.0] + [1.0] * (len(g) - 2))
    return np.linalg.lstsq(a, g[:-1, -1], rcond=None)[0]


def solve_logistic_step(state: DataFrame, ridge: float = 0.0) -> np.ndarray:
    """(intercept, weights) of the first Newton step of logistic regression from zero, from a state whose target is 0 or 1: all rows then have
    the curvature 1/4, so the step is least squares of 4 * (y - 1/2)."""
    g = matrix(state)
    a = g[:-1, :-1] + ridge * np.diag([0.0] + [1.0] * (len(g) - 2))
    return np.linalg.lstsq(a, 4 * (g[:-1, -1] - g[:-1, 0] / 2), rcond=None)[0]


def linear(x: Column, weights: np.ndarray) -> Column:
    """The fitted value of features."""
    return vec.dot(x, F.lit([float(w) for w in weights[1:]])) + float(weights[0])


def probability(x: Column, weights: np.ndarray) -> Column:
    return 1 / (1 + F.exp(-linear(x, weights)))

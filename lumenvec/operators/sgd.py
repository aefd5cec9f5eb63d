"""Logistic and softmax regression by mini-batches: SGD, momentum, Nesterov and Adam, a grid of settings in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("SGD", "Momentum", "Nesterov", "Adam")
#: Share of the earlier direction that momentum keeps; Adam's two decay rates and its least divisor.
KEEP, DECAY, FLOOR = 0.9, (0.9, 0.999), 1e-8
WEIGHTS = "setting int, class int, place int, weight double, first double, second double, steps int"


@dataclass(frozen=True)
class Setting:
    """``batches`` a pass; it divides the finest setting's number."""

    rate: float
    l2: float
    batches: int
    method: str = "Adam"


def write_batches(rows: DataFrame, path: str, batches: int, key: str = "id", seed: int = 5) -> None:
    """(x, y, weight) of ``rows`` as a table with a folder for each mini-batch, chosen by a hash of the key: a step then reads its own rows only."""
    batch = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(batches)).cast("int")
    rows.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight"), batch.alias("batch")).dropna().write.partitionBy("batch").parquet(path)


def chances(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Settings x rows x classes, of weights settings x classes x (1 + features). One class stands for label 1 of two."""
    z = np.einsum("nd,scd->snc", x, w[:, :, 1:]) + w[:, None, :, 0]
    if w.shape[1] == 1:
        return 1 / (1 + np.exp(-z))
    e = np.exp(z - z.max(2, keepdims=True))
    return e / e.sum(2, keepdims=True)


def gradient_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows of weight * (chance - truth) * (1, x), for each setting and class."""
    truth = (y[:, None] == np.arange(w.shape[1])[None]) if w.shape[1] > 1 else (y == 1)[:, None]
    off = (chances(x, w) - truth[None]) * weight[None, :, None]
    return np.einsum("snc,nd->scd", off, np.column_stack([np.ones(len(x)), x]))


def _gradients(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mass = np.zeros_like(w), 0.0
        for b in batches:
            if b.num_rows:
                weight = b.column(2).to_numpy()
                total += gradient_sums(np.stack(b.column(0).to_numpy(zero_copy_only=False)), b.column(1).to_numpy(), weight, w)
                mass += weight.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, w.size)), pa.array(np.r_[mass, total.ravel()])], ["place", "g"])

    return run


class Optimiser:
    """Weights of all settings and what their methods remember; the sums of a setting with larger batches wait until its batch is whole."""

    def __init__(self, settings: list[Setting], classes: int, dim: int) -> None:
        if any(s.method not in METHODS for s in settings):
            raise ValueError(f"methods are {METHODS}")
        self.settings, self.finest = settings, max(s.batches for s in settings)
        if any(self.finest % s.batches for s in settings):
            raise ValueError("numbers of batches must divide the largest")
        self.w, self.first, self.second, self.sums = (np.zeros((len(settings), classes, dim + 1)) for _ in range(4))
        self.steps, self.mass, self.seen = (np.zeros(len(settings), t) for t in (int, float, int))

    def looked_at(self) -> np.ndarray:
        """Weights at which gradients are taken: Nesterov looks ahead."""
        ahead = np.array([s.rate * KEEP if s.method == "Nesterov" else 0.0 for s in self.settings])
        return self.w - ahead[:, None, None] * self.first

    def take(self, sums: np.ndarray, mass: float) -> None:
        """The gradient sums of one of the finest batches."""
        at = self.looked_at()
        self.sums += sums
        self.mass += mass
        self.seen += 1
        for k, s in enumerate(self.settings):
            if self.seen[k] < self.finest // s.batches:
                continue
            if self.mass[k] > 0:
                g = self.sums[k] / self.mass[k]
                g[:, 1:] += s.l2 * at[k][:, 1:]
                self.steps[k] += 1
                if s.method == "Adam":
                    self.first[k] = DECAY[0] * self.first[k] + (1 - DECAY[0]) * g
                    self.second[k] = DECAY[1] * self.second[k] + (1 - DECAY[1]) * g * g
                    t = self.steps[k]
                    self.w[k] -= s.rate * (self.first[k] / (1 - DECAY[0] ** t)) / (np.sqrt(self.second[k] / (1 - DECAY[1] ** t)) + FLOOR)
                elif s.method == "SGD":
                    self.w[k] -= s.rate * g
                else:
                    self.first[k] = KEEP * self.first[k] + g
                    self.w[k] -= s.rate * self.first[k]
            self.sums[k], self.mass[k], self.seen[k] = 0.0, 0.0, 0

    def table(self, spark: SparkSession) -> DataFrame:
        s, c, p = np.indices(self.w.shape).reshape(3, -1).tolist()
        return spark.createDataFrame(list(zip(s, c, p, self.w.ravel().tolist(), self.first.ravel().tolist(), self.second.ravel().tolist(), self.steps[s].tolist(), strict=True)), WEIGHTS)

    def load(self, table: DataFrame) -> None:
        for r in table.collect():  # a row per setting, class and feature
            at = (r["setting"], r["class"], r["place"])
            self.w[at], self.first[at], self.second[at], self.steps[r["setting"]] = r["weight"], r["first"], r["second"], r["steps"]


def epoch_order(epoch: int, batches: int, seed: int = 5) -> list[int]:
    return np.random.default_rng([seed, epoch]).permutation(batches).tolist()


def train(spark: SparkSession, batches: str, settings: list[Setting], dim: int, epochs: int, path: str, classes: int = 1) -> np.ndarray:
    """Weights settings x classes x (1 + features), trained on a table of ``write_batches``; class 1 of two has one row of weights.

    Every step sums gradients of all settings over one batch's rows, so a grid costs one pass over the rows an epoch. What the driver gets
    is a number for each setting, class and feature. After an epoch the weights and what the methods remember are written below ``path``;
    a run that finds epochs there goes on after the last, with the same steps as one that didn't stop. Empty batches make no step.
    """
    state, begun = Optimiser(settings, classes, dim), 0
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    while fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={begun}/_SUCCESS")):
        begun += 1
    if begun:
        state.load(spark.read.schema(WEIGHTS).parquet(f"{path}/epoch={begun - 1}"))
    rows = spark.read.schema("x array<double>, y int, weight double, batch int").parquet(batches)
    for epoch in range(begun, epochs):
        for b in epoch_order(epoch, state.finest):
            sums = rows.where(F.col("batch") == b).select("x", "y", "weight").mapInArrow(_gradients(state.looked_at()), "place long, g double").groupBy("place").agg(F.sum("g").alias("g"))
            held = {r["place"]: r["g"] for r in sums.collect()}
            if held:
                state.take(np.array([held[i] for i in range(state.w.size)]).reshape(state.w.shape), held[-1])
        state.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return state.w


def scores(x: Column, w: np.ndarray) -> Column:
    """Chances of the classes of one setting's weights, as an array; of one class, the chance of label 1."""
    dots = [F.aggregate(F.zip_with(x, F.lit(c[1:].tolist()), lambda a, b: a * b), F.lit(float(c[0])), lambda a, b: a + b) for c in w]
    if len(dots) == 1:
        return F.array(1 / (1 + F.exp(-dots[0])))
    top = F.greatest(*dots)
    e = [F.exp(z - top) for z in dots]
    whole = e[0]
    for z in e[1:]:
        whole = whole + z
    return F.transform(F.array(*e), lambda z: z / whole)

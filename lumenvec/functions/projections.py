"""Seeded random projections and what is built on them: sign codes, tight frames, subsampled Hadamard rows, sampled codebooks."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenvec.functions.vec import doubles, signs

KINDS = ("gaussian", "orthogonal", "signs", "sparse", "very_sparse", "uniform")


def _seeded(*key) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32("|".join(map(str, key)).encode()))


def matrix(kind: str, k: int, dim: int, seed: str = "project") -> np.ndarray:
    """k rows of ``dim`` entries with mean 0, scaled so that the projection keeps squared lengths on average.

    ``orthogonal`` rows come in groups of up to ``dim`` from Haar-distributed bases; ``sparse`` has a third of its entries, ``very_sparse``
    one in sqrt(dim), not zero.
    """
    r = _seeded(seed, kind, k, dim)
    if kind == "gaussian":
        return r.standard_normal((k, dim)) / math.sqrt(k)
    if kind == "uniform":
        return r.uniform(-math.sqrt(3), math.sqrt(3), (k, dim)) / math.sqrt(k)
    if kind == "signs":
        return r.choice([-1.0, 1.0], (k, dim)) / math.sqrt(k)
    if kind in ("sparse", "very_sparse"):
        s = 3.0 if kind == "sparse" else math.sqrt(dim)
        return r.choice([-1.0, 0.0, 1.0], (k, dim), p=[0.5 / s, 1 - 1 / s, 0.5 / s]) * math.sqrt(s / k)
    if kind != "orthogonal":
        raise ValueError(kind)
    bases = []
    for _ in range(-(-k // dim)):
        q, t = np.linalg.qr(r.standard_normal((dim, dim)))
        bases.append((q * np.sign(np.diag(t))).T)
    return np.vstack(bases)[:k] * math.sqrt(dim / k)


def project(v: Column, rows: np.ndarray, codes: bool = False) -> Column:
    """The products of a vector with every row, or their signs (+1 at zero) if ``codes``; null for null and for another length."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out = [None] * len(s)
        at = [i for i, x in enumerate(s) if x is not None and len(x) == rows.shape[1]]
        if at:
            p = np.stack([np.asarray(s.iloc[i], np.float64) for i in at]) @ rows.T
            for i, x in zip(at, np.where(p < 0, -1.0, 1.0) if codes else p):
                out[i] = x
        return pd.Series(out, dtype=object)

    return run(doubles(v))


def _subset(size: int, k: int, seed: str) -> list[int]:
    return sorted(int(i) for i in _seeded(seed, size, k).choice(size, k, replace=False))


def hadamard_rows(dim: int, k: int, seed: str = "subset") -> np.ndarray:
    """The matrix of ``subsampled_hadamard``."""
    size = 1 << (dim - 1).bit_length()
    parity = [[(i & j).bit_count() & 1 for j in range(dim)] for i in _subset(size, k, seed)]
    return (1.0 - 2.0 * np.array(parity)) * np.array(signs(size, seed))[:dim] / math.sqrt(k)


def subsampled_hadamard(v: Column, dim: int, k: int, seed: str = "subset") -> Column:
    """k coordinates, drawn without replacement, of the Hadamard transform after sign flips and padding with zeros to a power of two.

    Scaled to keep lengths on average; a batch takes log2 steps of sums and differences. Null for null and for another length.
    """
    size = 1 << (dim - 1).bit_length()
    flips, kept = np.array(signs(size, seed))[:dim], _subset(size, k, seed)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = [None] * len(s)
            at = [i for i, x in enumerate(s) if x is not None and len(x) == dim]
            x = np.zeros((len(at), size))
            for row, i in enumerate(at):
                x[row, :dim] = np.asarray(s.iloc[i], np.float64) * flips
            step = 1
            while step < size:
                pair = x.reshape(len(at), size // (2 * step), 2, step)
                x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(at), size)
                step *= 2
            for row, i in enumerate(at):
                out[i] = x[row, kept] / math.sqrt(k)
            yield pd.Series(out, dtype=object)

    return run(doubles(v))


def sampled_codebook(bits: int, rounds: int = 40, sample: int = 200_000) -> list[float]:
    """Levels for N(0, 1) values by Lloyd's iteration on a seeded sample of fixed size."""
    x = np.sort(_seeded("levels", bits).standard_normal(sample))
    sums = np.concatenate([[0.0], np.cumsum(x)])
    levels = np.quantile(x, (np.arange(1 << bits) + 0.5) / (1 << bits))
    for _ in range(rounds):
        ends = np.concatenate([[0], np.searchsorted(x, (levels[1:] + levels[:-1]) / 2), [sample]])
        n = np.diff(ends)
        levels = np.where(n > 0, np.diff(sums[ends]) / np.maximum(n, 1), levels)
    return [float(t) for t in levels]

"""Scalar quantizers of vector coordinates: Gaussian codebooks that contain one another, float8, and seeded projections."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenvec.functions.vec import doubles, signs, total

_NORMAL = NormalDist()


def gaussian_codebook(bits: int) -> tuple[list[float], list[float]]:
    """(cuts, levels) for N(0, 1) values. Cells are equally likely under N(0, 3), the density of the best fine quantizer, so that codes of
    fewer bits are the upper bits of longer ones; a level is its cell's mean."""
    cells = 1 << bits
    cuts = [math.sqrt(3) * _NORMAL.inv_cdf(i / cells) for i in range(1, cells)]
    density = [0.0, *(_NORMAL.pdf(c) for c in cuts), 0.0]
    below = [0.0, *(_NORMAL.cdf(c) for c in cuts), 1.0]
    return cuts, [(density[i] - density[i + 1]) / (below[i + 1] - below[i]) for i in range(cells)]


def encode(v: Column, bits: int, scale: float) -> Column:
    """Code of each coordinate times ``scale``: the number of cuts not above it."""
    cuts = np.array(gaussian_codebook(bits)[0])

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        held = [np.zeros(0) if x is None else np.asarray(x, np.float64) for x in s]
        flat = np.searchsorted(cuts, np.concatenate(held or [np.zeros(0)]) * scale, side="right").astype(np.int32)
        parts = np.split(flat, np.cumsum([len(x) for x in held])[:-1])
        return pd.Series([None if x is None else p for x, p in zip(s, parts)], index=s.index, dtype=object)

    return run(doubles(v))


def decode(codes: Column, bits: int, scale: float) -> Column:
    levels = F.lit(gaussian_codebook(bits)[1])
    return F.transform(codes, lambda c: F.get(levels, c) / scale)


def bf16_cut(v: Column, bits: int = 16) -> Column:
    """``vec.to_bf16`` for batches of rows; null components stay null."""
    mask = (0xFFFF << (16 - bits)) & 0x7FFF

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        held = [np.zeros(0) if x is None else np.asarray(x, np.float64) for x in s]
        x = np.concatenate(held or [np.zeros(0)])
        a = np.where(np.isfinite(x), np.abs(x), 0)
        m, e = np.frexp(a)
        code = np.where(a == 0, 0, np.rint((m * 2 - 1) * 128).astype(np.int64) + (e.astype(np.int64) + 126) * 128)
        kept = code & mask
        cut = np.where(np.isnan(x), np.nan, np.where(kept < 128, 0.0, np.sign(x) * np.ldexp(1 + (kept % 128) / 128.0, kept // 128 - 127)))
        parts = np.split(cut, np.cumsum([len(x) for x in held])[:-1])
        return pd.Series([None if x is None else p for x, p in zip(s, parts)], index=s.index, dtype=object)

    return run(doubles(v))


def float8(x: Column, mantissa: int, least_exponent: int, most: float) -> Column:
    """The nearest small float (ties toward zero): e4m3 is (3, -6, 448), e5m2 (2, -14, 57344)."""
    a = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.when(a == 0, 1.0).otherwise(a))), F.lit(least_exponent)) - mantissa)
    return F.sign(x) * F.least(F.lit(most), F.ceil(a / step - 0.5) * step)


def sign_projection(v: Column, dim: int, k: int, seed: str = "project") -> Column:
    """k random projections with entries of +1 or -1, scaled to keep lengths; their signs are SimHash bits."""
    rows = [F.lit(signs(dim, f"{seed}|{r}")) for r in range(k)]
    return F.array(*[total(F.zip_with(doubles(v), r, lambda x, s: x * s)) / math.sqrt(k) for r in rows])

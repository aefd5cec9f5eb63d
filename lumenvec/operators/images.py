"""Raw RGB rasters in binary columns: area and nearest downsampling, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _linear(x: np.ndarray) -> np.ndarray:
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


def _curve(x: np.ndarray) -> np.ndarray:
    return np.where(x <= 0.0031308, x * 12.92, 1.055 * np.maximum(x, 0.0031308) ** (1 / 2.4) - 0.055)


def _shares(side: int, new: int) -> np.ndarray:
    """The share of each old pixel in each new one, by covered length."""
    edges = np.arange(new + 1) * side / new
    return np.maximum(0, np.minimum(edges[1:, None], np.arange(1, side + 1)) - np.maximum(edges[:-1, None], np.arange(side))) * new / side


def _stacked(batches: Iterator[pd.Series], shape: tuple[int, int], shrink: Callable[[np.ndarray], np.ndarray]) -> Iterator[pd.Series]:
    """``shrink`` of all rasters of a batch at once, as bytes; null, and bytes that are no raster of that shape, give null."""
    for s in batches:
        out = [None] * len(s)
        at = [i for i, raw in enumerate(s) if raw is not None and len(raw) == shape[0] * shape[1] * 3]
        if at:
            small = shrink(np.frombuffer(b"".join(s.iloc[i] for i in at), np.uint8).reshape(len(at), *shape, 3))
            for i, raster in zip(at, small, strict=True):
                out[i] = raster.tobytes()
        yield pd.Series(out, dtype=object)


def _in_light(pixels: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Square rasters times weights of old pixels for new ones, along both sides, in linear light."""
    small = np.einsum("ia,nabc,jb->nijc", w, _linear(pixels / 255.0), w, optimize=True)
    return np.rint(np.clip(_curve(np.clip(small, 0, 1)), 0, 1) * 255).astype(np.uint8)


def shrink_area(raster: Column, side: int, new: int) -> Column:
    """Square rasters by the mean of covered areas in linear light; null, and bytes that are no raster of that side, give null."""
    w = _shares(side, new)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _stacked(batches, (side, side), lambda x: _in_light(x, w))

    return run(raster)


def shrink_nearest(raster: Column, side: int, new: int) -> Column:
    """Square rasters by the pixel at the middle of each new one; otherwise as ``shrink_area``."""
    at = ((np.arange(new) + 0.5) * side / new).astype(int)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _stacked(batches, (side, side), lambda x: x[:, at][:, :, at])

    return run(raster)


def _lanczos(side: int, new: int, lobes: int) -> np.ndarray:
    """The weight of each old pixel in each new one: the windowed sinc at the new pixel's middle, edges repeated, rows summing to 1."""
    w = np.zeros((new, side))
    for i in range(new):
        middle = (i + 0.5) * side / new - 0.5
        near = np.arange(int(np.floor(middle)) - lobes + 1, int(np.floor(middle)) + lobes + 1)
        x = near - middle
        np.add.at(w[i], np.clip(near, 0, side - 1), np.where(abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0))
    return w / w.sum(axis=1, keepdims=True)


def crop_square(pixels: np.ndarray) -> np.ndarray:
    """The largest square in the middle of rasters by rows by columns by channels."""
    h, w = pixels.shape[1:3]
    n = min(h, w)
    return pixels[:, (h - n) // 2 : (h - n) // 2 + n, (w - n) // 2 : (w - n) // 2 + n]


def shrink_lanczos(raster: Column, height: int, width: int, new: int, lobes: int = 4) -> Column:
    """The middle square by area to twice the new side, then by Lanczos to it, in linear light; bytes that are no such raster give null."""
    side = min(height, width)
    w = _lanczos(2 * new, new, lobes) @ _shares(side, 2 * new)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _stacked(batches, (height, width), lambda x: _in_light(crop_square(x), w))

    return run(raster)

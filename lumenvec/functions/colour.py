"""Colours: transfer curves and OKLCH to sRGB as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published OKLab matrices, from (l, a, b) to cube roots of cone responses and from cones to linear sRGB.
LAB_TO_CONES = [(1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480)]
CONES_TO_RGB = [(4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010)]


def to_srgb(linear: Column) -> Column:
    """Linear light in 0..1 to the sRGB curve."""
    return F.when(linear <= 0.0031308, linear * 12.92).otherwise(1.055 * F.pow(F.greatest(linear, F.lit(0.0031308)), F.lit(1 / 2.4)) - 0.055)


def to_linear(s: Column) -> Column:
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def oklch_to_srgb(lightness: Column, chroma: Column, hue: Column) -> list[Column]:
    """[r, g, b] in 0..1, cut to the gamut; hue in turns."""
    lab = (lightness, chroma * F.cos(hue * 2 * math.pi), chroma * F.sin(hue * 2 * math.pi))
    cones = [F.pow(sum(m * c for m, c in zip(row, lab, strict=True)), F.lit(3.0)) for row in LAB_TO_CONES]
    light = [sum(m * c for m, c in zip(row, cones, strict=True)) for row in CONES_TO_RGB]
    return [to_srgb(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))) for x in light]

"""Vector columns as native expressions: products, norms, distances, precision cuts, rotation, projection, quantization."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda of ``body`` the value itself would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0)), lambda n: F.transform(doubles(v), lambda x: x / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is zero."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def bf16(x: Column, bits: int = 16) -> Column:
    """Round to the nearest bfloat16 (ties to even), then keep the upper ``bits`` of its 16: sign, 8 exponent bits, 7 of mantissa."""
    a = F.abs(x.cast("double"))
    e = F.floor(F.log2(F.when(a == 0, 1.0).otherwise(a)))
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
    code = (F.rint((a / F.pow(F.lit(2.0), e) - 1) * 128) + (e + 127) * 128).cast("long")
    code = F.when(a == 0, F.lit(0).cast("long")).otherwise(code)
    kept = code.bitwiseAND(F.lit((0xFFFF << (16 - bits)) & 0x7FFF).cast("long"))
    value = (1 + (kept % 128) / 128.0) * F.pow(F.lit(2.0), F.floor(kept / 128) - 127)
    return F.when(kept < 128, 0.0).otherwise(F.signum(x.cast("double")) * value)


def to_bf16(v: Column, bits: int = 16) -> Column:
    return F.transform(v, lambda x: bf16(x, bits))


def to_int8(v: Column, scale: float) -> Column:
    """Tanh companding of scaled coordinates to -127..127."""
    return F.transform(doubles(v), lambda x: F.round(127 * F.tanh(x * scale / 2)).cast("int"))


def from_int8(codes: Column, bits: int = 8) -> Column:
    """Coordinates of codes cut to their upper ``bits``, each at the middle of the codes it stands for."""
    step = 1 << (8 - bits)
    middle = lambda q: F.floor(q.cast("double") / step) * step + step / 2.0 if bits < 8 else q.cast("double")
    return F.transform(codes, lambda q: 2 * F.atanh(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), middle(q))) / 127.5))


def mask_int8(codes: Column, bits: int) -> Column:
    """The floor form of a cut: two's-complement codes under a mask."""
    return F.transform(codes, lambda q: q.cast("int").bitwiseAND(F.lit(-(1 << (8 - bits)))).cast("double"))


def signs(dim: int, seed: str = "rotate") -> list[float]:
    return [1.0 if hashlib.md5(f"{seed}|{j}".encode()).digest()[0] & 1 else -1.0 for j in range(dim)]


def hadamard_rotate(v: Column, dim: int, seed: str = "rotate") -> Column:
    """Seeded sign flips, then the Hadamard transform of blocks of the largest power of two that divides ``dim``; lengths are kept.

    log2 rounds of sums and differences of pairs, each round's array computed once.
    """
    block = dim & -dim
    x = F.zip_with(doubles(v), F.lit(signs(dim, seed)), lambda x, s: x * s / math.sqrt(block))
    places = F.sequence(F.lit(0), F.lit(dim - 1))

    def pairs(h: int) -> Callable[[Column], Column]:
        return lambda y: F.transform(places, lambda i: F.when(i.bitwiseAND(F.lit(h)) == 0, F.get(y, i) + F.get(y, i + h)).otherwise(F.get(y, i - h) - F.get(y, i)))

    step = 1
    while step < block:
        x = let(x, pairs(step))
        step *= 2
    return F.when(F.size(v) == dim, x)


def project3(v: Column, slices: list[tuple[int, int]]) -> list[Column]:
    """Sums of slices (start from 1, length): the linear map's coordinates."""
    return [total(F.slice(doubles(v), a, n)) for a, n in slices]


def spread_bits(x: Column) -> Column:
    """The lower 31 bits with a zero between each two."""
    x = x.cast("long").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(x: Column, y: Column) -> Column:
    """Z-order of two 32-bit coordinates at 31 bits each, so that it fits a signed long."""
    return spread_bits(F.shiftright(x.cast("long"), 1)).bitwiseOR(F.shiftleft(spread_bits(F.shiftright(y.cast("long"), 1)), 1))


def hash_int(c: Column) -> Column:
    """A portable 32-bit hash: the first eight hex digits of the MD5 of the value as text."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")

"""Tile reads of a Z-ordered copy: a rectangle is split into few intervals of the key, which reach the scan as predicates."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.functions.vec import morton

#: Bits of a coordinate in the key; the lowest of 32 is left out.
BITS = 31
#: Intervals that a rectangle is split into at most. More fit it closer; each is one more predicate to test.
INTERVALS = 16


def _spread(v: int) -> int:
    return sum((v >> i & 1) << 2 * i for i in range(BITS))


def intervals(x0: int, x1: int, y0: int, y1: int, most: int = INTERVALS) -> list[tuple[int, int]]:
    """At most ``most`` key intervals [lo, hi] that hold every point of the rectangle of 32-bit coordinates, ends included.

    The quarter that reaches furthest beyond the rectangle is split first; in the end the intervals with the least gaps between them are
    joined. An empty rectangle has none.
    """
    if x0 > x1 or y0 > y1:
        return []
    x0, x1, y0, y1 = x0 >> 1, x1 >> 1, y0 >> 1, y1 >> 1

    def cell(level: int, x: int, y: int) -> tuple[int, int, int, int] | None:
        """(minus the area outside, level, x, y); None if the cell has no point of the rectangle."""
        side = 1 << level
        w, h = min(x1, x + side - 1) - max(x0, x) + 1, min(y1, y + side - 1) - max(y0, y) + 1
        return (w * h - side * side, level, x, y) if w > 0 and h > 0 else None

    heap = [cell(BITS, 0, 0)]
    while heap[0][0] < 0 and len(heap) < 4 * most:
        _, level, x, y = heapq.heappop(heap)
        half = 1 << (level - 1)
        for q in range(4):
            if (c := cell(level - 1, x + (q & 1) * half, y + (q >> 1) * half)) is not None:
                heapq.heappush(heap, c)
    found = sorted((z := _spread(x) | _spread(y) << 1, z + (1 << 2 * level) - 1) for _, level, x, y in heap)
    gaps = sorted(range(1, len(found)), key=lambda i: found[i][0] - found[i - 1][1])
    joined = {i for k, i in enumerate(gaps) if found[i][0] - found[i - 1][1] == 1 or k < len(found) - most}
    out: list[tuple[int, int]] = []
    for i, (lo, hi) in enumerate(found):
        if i in joined:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def in_intervals(key: Column, spans: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [key.between(lo, hi) for lo, hi in spans], F.lit(False))


def write_map(df: DataFrame, path: str, x: str = "x", y: str = "y", files: int = 8, group_bytes: int = 128 << 20) -> None:
    """A copy of ``df`` by Z-order of two 32-bit coordinates: files are ranges of the key ``zkey``, sorted, so that row groups and pages are narrow.

    Rows with a null coordinate have a null key and come first; no tile holds them.
    """
    z = df.withColumn("zkey", morton(F.col(x), F.col(y)))
    z.repartitionByRange(files, "zkey").sortWithinPartitions("zkey").write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 2_000).parquet(path)


def read_tile(spark: SparkSession, path: str, x0: int, x1: int, y0: int, y1: int, x: str = "x", y: str = "y", most: int = INTERVALS) -> DataFrame:
    """The points of a rectangle, ends included, from a copy that ``write_map`` made: intervals of the key are pushed to the scan, then the
    coordinates are tested, as intervals may reach beyond the rectangle."""
    spans = intervals(x0, x1, y0, y1, most)
    return spark.read.parquet(path).where(in_intervals(F.col("zkey"), spans)).where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))

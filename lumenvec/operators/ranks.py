"""Row numbers and ranks of whole tables, in ranges of the order instead of one window over everything."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.operators import blocks

#: Rows of a range at about most, ranges at most, and rows of the hashed sample that ranges are cut at.
RANGE_ROWS, MOST_RANGES, CUT_SAMPLE = 500_000, 10_000, 100_000


def _ranges(df: DataFrame, keys: list[str], rows: int | None) -> Column:
    """The number of each row's range: how many cuts its keys are not below. Equal keys are in one range."""
    n = min(MOST_RANGES, -(-df.count() // (rows or RANGE_ROWS)))
    if n <= 1:
        return F.lit(0)
    sample = df.select(F.struct(*keys).alias("k")).orderBy(F.xxhash64(*keys)).limit(min(CUT_SAMPLE, 50 * n)).select("k.*").distinct()
    held = [tuple(r) for r in sample.orderBy(*keys).collect()]  # bounded by the sample
    cuts = df.sparkSession.createDataFrame([held[len(held) * i // n] for i in range(1, n)], df.select(*keys).schema).distinct()
    listed = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, cuts.schema)]) for r in cuts.orderBy(*keys).collect()]
    step = max(1, int(len(listed) ** 0.5))
    below = lambda some: F.size(F.filter(some, lambda c: c <= F.struct(*keys)))
    coarse = below(F.array(*listed[step - 1 :: step])) * step  # first among every step-th cut, then among those of that step
    return coarse + below(F.slice(F.array(*listed), coarse + 1, F.lit(step)))


def _offsets(ranged: DataFrame) -> DataFrame:
    """The rows before each range; a row per range goes through one task."""
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))


def row_numbers(df: DataFrame, keys: list[str], name: str = "rn", rows: int | None = None) -> DataFrame:
    """``df`` with the number of each row, from 0, in the order of ``keys`` (ascending, nulls first)."""
    ranged = df.withColumn("range", _ranges(df, keys, rows))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*keys)) - 1
    return ranged.withColumn(name, inside).join(_offsets(ranged), "range").withColumn(name, F.col(name) + F.col("before")).drop("range", "before")


def average_ranks(df: DataFrame, key: str, name: str = "r", rows: int | None = None) -> DataFrame:
    """``df`` with the rank of each row by ``key``, from 1; ties share the mean of their places."""
    ranged = df.withColumn("range", _ranges(df, [key], rows))
    inside = F.rank().over(Window.partitionBy("range").orderBy(key)) + (F.count("*").over(Window.partitionBy("range", key)) - 1) / 2.0
    return ranged.withColumn(name, inside).join(_offsets(ranged), "range").withColumn(name, F.col(name) + F.col("before")).drop("range", "before")


def rank_in_parts(df: DataFrame, group: str, key: str, rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``key`` replaced by the rank of the row within its group and part, from 0, and ``<key>_part``.

    Parts are ranges of (group, key) that equal keys don't cross; ties share the least place. A group's rank is that and the group's rows in
    earlier parts (``correlations``). Rows are numbered as they pass, so a group may be of any size.
    """
    n = max(1, min(MOST_RANGES, -(-df.count() // rows)))
    sorted_ = df.repartitionByRange(n, group, key).sortWithinPartitions(group, key).withColumn(f"{key}_part", F.spark_partition_id())
    at = (df.columns.index(group), df.columns.index(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # group and key of the row before, its place and its rank
        for batch in batches:
            if not batch.num_rows:
                continue
            g, v = batch.column(at[0]).to_numpy(), batch.column(at[1]).to_numpy(zero_copy_only=False).astype(np.float64)
            v = np.where(np.isnan(v), np.inf, v)
            i = np.arange(len(g))
            fresh = np.append(last is None or last[0] != g[0], g[1:] != g[:-1])
            start = np.maximum.accumulate(np.where(fresh, i, -1))
            place = np.where(start >= 0, i - start, i + (last[2] + 1 if last else 0))
            new = fresh | np.append(last is None or last[1] != v[0], v[1:] != v[:-1])
            at_new = np.maximum.accumulate(np.where(new, i, -1))
            rank = np.where(at_new >= 0, place[np.maximum(at_new, 0)], last[3] if last else 0)
            last = (g[-1], v[-1], place[-1], rank[-1])
            yield pa.RecordBatch.from_arrays([pa.array(rank.astype(np.float64)) if c == at[1] else x for c, x in enumerate(batch.columns)], batch.schema.names)

    return sorted_.mapInArrow(run, sorted_.schema)


def part_moments(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Rows, sums, squares and products of two ranks in parts, by group and both parts."""
    x, y = F.col(a), F.col(b)
    return df.groupBy(group, f"{a}_part", f"{b}_part").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))


def correlations(moments: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, c): correlations of the ranks of whole groups from ``part_moments``, a row for each group and two parts."""
    for part, offset in ((f"{a}_part", "u"), (f"{b}_part", "v")):
        before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        rows = moments.groupBy(group, part).agg(F.sum("n").alias("rows")).withColumn(offset, F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("double")).drop("rows")
        moments = moments.join(rows, [group, part])
    n, x, y, xx, yy, xy, u, v = (F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy", "u", "v"))
    whole = moments.groupBy(group).agg(F.sum(n).alias("n"), F.sum(x + n * u).alias("x"), F.sum(y + n * v).alias("y"), F.sum(xx + 2 * u * x + n * u * u).alias("xx"), F.sum(yy + 2 * v * y + n * v * v).alias("yy"), F.sum(xy + u * y + v * x + n * u * v).alias("xy"))
    return whole.select(group, ((n * xy - x * y) / F.nullif(F.sqrt(n * xx - x * x) * F.sqrt(n * yy - y * y), F.lit(0.0))).alias("c"))


#: Pairs whose two distances a task holds at once at most.
HELD_PAIRS = 1 << 23


def _least_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 0; ties share the least."""
    order = np.argsort(x)
    held = x[order]
    rank = np.empty(len(x))
    rank[order] = np.maximum.accumulate(np.where(np.append(True, held[1:] != held[:-1])[: len(x)], np.arange(len(x)), 0))
    return rank


def query_correlations(pool: DataFrame, queries: DataFrame, score: blocks.Score, rows: int) -> DataFrame:
    """(qid, c): for each query the correlation of its ranks of the ``rows`` rows of ``pool`` by the two matrices of ``score``.

    A task has as many queries at once as ``HELD_PAIRS`` allow, and ``rows`` may be no more than these. Pairs are ranked where they are scored,
    so none is moved. Without a distance a pair comes last, of null vectors behind those; a row isn't ranked around itself.
    """

    def visit(q: blocks.Block, others: Iterator[blocks.Block]) -> Iterator[pa.RecordBatch]:
        keys, held = [], []
        for p in others:
            keys.append(p.keys)
            both = [np.where(np.isnan(x), 3.0, x) for x in score(p, q)]
            for x in both:
                x[:, p.sides[0][1] < 0] = 4.0
                x[q.sides[0][1] < 0] = 4.0
            held.append(both)
        found = np.full(len(q.keys), np.nan)
        all_keys = np.concatenate(keys)
        for i, key in enumerate(q.keys):
            apart = all_keys != key
            a, b = (_least_ranks(np.concatenate([x[c][i] for x in held])[apart]) for c in (0, 1))
            if len(a):
                a, b = a - a.mean(), b - b.mean()
                size = np.sqrt(a @ a) * np.sqrt(b @ b)
                found[i] = (a @ b) / size if size else np.nan
        some = np.array([(all_keys != key).any() for key in q.keys])
        yield from blocks._batch(["qid", "c"], [q.keys[some], found[some]])

    return blocks.meet(pool, queries, visit, "qid long, c double", query_rows=min(blocks.QUERY_ROWS, max(1, HELD_PAIRS // max(1, rows))))


#: Bins of equal width that distances up to 2 are counted in, and pairs of a range of bins at about most.
BINS, RANGE_PAIRS = 4096, 1_000_000
#: Pairs that a task holds before it deals them out.
DEALT_PAIRS = 1 << 20


def _centred(codes: np.ndarray, before: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``codes`` and, in it, their ranks among all ``n``, of which ``before`` are less, from the mean rank; ties share theirs."""
    order = np.argsort(codes, kind="stable")
    held = codes[order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(held)))
    return order, np.repeat(before + first + (size - 1) / 2 - (n - 1) / 2, size)


def block_correlations(pool: DataFrame, queries: DataFrame, score: blocks.Score, digits: list[int], rows: int = RANGE_PAIRS) -> DataFrame:
    """(cell, c): over all pairs, the rank correlation of each matrix of distances of ``score`` with the last one; ``digits`` are what they are rounded to.

    Pairs are counted in bins; bins in ranges give what lies before each. Pairs go to their range of the last matrix in packed columns, are ranked
    there, and go with that rank to their range of each other matrix, where products are summed. Pairs without a distance, and of a row with
    itself, take no part. A bin is one task's, however many pairs it has.
    """
    cells = len(digits)
    wide = [-(-2 * 10**x // (BINS - 1)) for x in digits]

    def coded(p: blocks.Block, q: blocks.Block) -> list[np.ndarray]:
        """Distances as whole numbers of their last digit, of the pairs that take part."""
        scores = score(p, q)
        live = q.keys[:, None] != p.keys[None, :]
        for x in scores:
            live &= ~np.isnan(x)
        return [np.maximum(np.rint(x[live] * 10.0**d), 0).astype(np.int64) for x, d in zip(scores, digits, strict=True)]

    def count(q: blocks.Block, others: Iterator[blocks.Block]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((cells, BINS), np.int64)
        for p in others:
            for c, x in enumerate(coded(p, q)):
                n[c] += np.bincount(x // wide[c], minlength=BINS)
        c, b = np.nonzero(n)
        yield from blocks._batch(["cell", "bin", "n"], [c.astype(np.int32), b.astype(np.int32), n[c, b]])

    counts = np.zeros((cells, BINS), np.int64)
    for r in blocks.meet(pool, queries, count, "cell int, bin int, n long").groupBy("cell", "bin").agg(F.sum("n").alias("n")).collect():  # a row for each bin
        counts[r["cell"], r["bin"]] = r["n"]
    n, before = int(counts[0].sum()), np.cumsum(counts, 1) - counts
    of_bin = before // rows  # the range of each bin; numbers may be left out
    start = [{int(r): int(before[c][np.argmax(of_bin[c] == r)]) for r in np.unique(of_bin[c])} for c in range(cells)]

    def parts(c: int, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each range of matrix ``c`` that has some of ``codes``, and where they are."""
        r = of_bin[c][codes // wide[c]].astype(np.int32)
        order = np.argsort(r, kind="stable")
        cuts = np.flatnonzero(np.append(True, r[order][1:] != r[order][:-1])) if len(r) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(r)), strict=True):
            yield int(r[order[lo]]), order[lo:hi]

    def deal(q: blocks.Block, others: Iterator[blocks.Block]) -> Iterator[pa.RecordBatch]:
        held, m = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            x = [np.concatenate(part) for part in zip(*held, strict=True)]
            found = [(r, x[-1][at].tobytes(), b"".join(y[at].astype(np.uint32).tobytes() for y in x[:-1])) for r, at in parts(cells - 1, x[-1])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "last", "others"])

        for p in others:
            held.append(coded(p, q))
            m += len(held[-1][0])
            if m >= DEALT_PAIRS:
                yield from out()
                held, m = [], 0
        if held:
            yield from out()

    def ranked(key: tuple, table: pa.Table) -> pa.Table:
        last = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["last"]])
        others = np.concatenate([np.frombuffer(x.as_py(), np.uint32).reshape(cells - 1, -1) for x in table["others"]], 1)
        order, rank = _centred(last, start[-1][key[0].as_py()], n)
        found = []
        for c in range(cells - 1):
            x = others[c][order]
            found += [(c, r, x[at].tobytes(), rank[at].tobytes()) for r, at in parts(c, x)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cell", "range", "codes", "ranks"])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        c, r = (k.as_py() for k in key)
        codes = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["codes"]])
        other = np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in table["ranks"]])
        order, rank = _centred(codes, start[c][r], n)
        other = other[order]
        return pa.table({"cell": pa.array([c], pa.int32()), "xx": [float(rank @ rank)], "yy": [float(other @ other)], "xy": [float(rank @ other)]})

    dealt = blocks.meet(pool, queries, deal, "range long, last binary, others binary")
    sums = dealt.groupBy("range").applyInArrow(ranked, "cell int, range long, codes binary, ranks binary").groupBy("cell", "range").applyInArrow(summed, "cell int, xx double, yy double, xy double")
    return sums.groupBy("cell").agg((F.sum("xy") / F.nullif(F.sqrt(F.sum("xx")) * F.sqrt(F.sum("yy")), F.lit(0.0))).alias("c"))

"""All pairs of two sides in blocks: each side is packed into rows of some hundred vectors, Spark joins blocks with blocks, and a task scores a
pair of blocks at once in numpy.

A side is (id, vectors...). Products of whole-numbered vectors come from a matrix product; all others are summed coordinate by coordinate from
the left, as the column expressions of ``vec`` do, so that equal vectors are at equal distances wherever they stand. ``close_pairs`` and
``close_nearest`` take the matrix product to tell which pairs matter, by a bound on what it may be off, and sum only those from the left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block of the pool and of one of the queries.
POOL_ROWS, QUERY_ROWS = 512, 256
#: Distances that a task hands on at once.
OUT_ROWS = 65_536
#: Rows of a part of the pool at most about, and rows and bytes of an Arrow batch, which Spark and Python workers hold several times over.
PART_ROWS, BATCH_ROWS, BATCH_BYTES = 65_536, 4096, 8 << 20


class Block:
    """Ids in ascending order and, for each vector column, a matrix padded with zeros and the length of each row, -1 where it is null."""

    def __init__(self, keys: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.keys, self.sides = keys, sides
        self._norms: dict[tuple[int, int | None], np.ndarray] = {}
        self._whole: dict[int, bool] = {}

    def cut(self, side: int, dims: int | None) -> np.ndarray:
        return self.sides[side][0][:, :dims]

    def whole(self, side: int) -> bool:
        """Whether all coordinates are small multiples of a half, so that no product or sum of them is rounded."""
        if side not in self._whole:
            m = self.sides[side][0] * 2
            self._whole[side] = bool((m == np.rint(m)).all() and (np.abs(m) < 1 << 20).all())
        return self._whole[side]

    def norms(self, side: int, dims: int | None) -> np.ndarray:
        if (side, dims) not in self._norms:
            m, n = self.cut(side, dims), np.zeros(len(self.keys))
            for j in range(m.shape[1]):
                n += m[:, j] * m[:, j]
            n = np.sqrt(n)
            self._norms[side, dims] = np.where((n == 0) | (self.sides[side][1] < 0), np.nan, n)
        return self._norms[side, dims]


def _products(p: np.ndarray, q: np.ndarray, fast: bool) -> np.ndarray:
    """(queries, pool) products of two matrices over their common coordinates."""
    d = min(p.shape[1], q.shape[1])
    if fast:
        return q[:, :d] @ p[:, :d].T
    out, one = np.zeros((len(q), len(p))), np.empty((len(q), len(p)))
    cols, rows = np.ascontiguousarray(p[:, :d].T), np.ascontiguousarray(q[:, :d].T)
    for j in range(d):
        np.multiply(rows[j][:, None], cols[j][None, :], out=one)
        out += one
    return out


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves away from zero."""
    if digits is None:
        return x
    y = x * 10.0**digits
    y += np.copysign(0.5, y)
    np.trunc(y, out=y)
    y /= 10.0**digits
    return y


def cosine_distances(p: Block, q: Block, a: int = 0, b: int = 0, dims: int | None = None, digits: int | None = None, fast: bool = False) -> np.ndarray:
    """(queries, pool) cosine distances of side ``a`` of the pool and side ``b`` of the queries on their first ``dims`` coordinates; not a
    number for vectors that are null, zero or of unequal length. ``fast`` takes the matrix product, for distances that are rounded."""
    dot = _products(p.cut(a, dims), q.cut(b, dims), fast or p.whole(a) and q.whole(b))
    with np.errstate(invalid="ignore", over="ignore"):
        dist = 1 - dot / (q.norms(b, dims)[:, None] * p.norms(a, dims)[None, :])
    long_, short = p.sides[a][1], q.sides[b][1]
    if dims is not None:
        long_, short = np.minimum(long_, dims), np.minimum(short, dims)
    if len(long_) and len(short) and (long_.min() != long_.max() or short.min() != short.max() or long_[0] != short[0]):
        dist[short[:, None] != long_[None, :]] = np.nan
    return rounded(dist, digits)


def _squeezed(m: np.ndarray) -> tuple[bytes, bytes]:
    """The cells of a matrix in the fewest bytes that keep each as it is, and their distinct values where cells are places among these."""
    if (np.abs(m) <= 127).all() and (m == np.rint(m)).all():
        return m.astype(np.int8).tobytes(), b""  # codes take a byte
    book, at = np.unique(m, return_inverse=True)
    if 16 * len(book) <= m.size and len(book) <= 1 << 16:
        return at.astype(np.uint8 if len(book) <= 1 << 8 else np.uint16).tobytes(), book.tobytes()
    with np.errstate(over="ignore"):
        single = m.astype(np.float32)
    return (single if ((single == m) | np.isnan(m)).all() else m).tobytes(), b""


def _unsqueezed(values: bytes, book: bytes, rows: int, width: int) -> np.ndarray:
    size = len(values) // max(1, rows * width)
    if not size:
        return np.zeros((rows, width))
    if len(book):
        m = np.frombuffer(book)[np.frombuffer(values, np.uint8 if size == 1 else np.uint16)]
    else:
        m = np.frombuffer(values, {1: np.int8, 4: np.float32, 8: np.float64}[size]).astype(np.float64)
    return m.reshape(rows, width)


def packed(df: DataFrame, name: str, rows: int, together: int = 1) -> DataFrame:
    """Blocks of about ``rows`` rows of ``df`` (id, vectors...): a column of ids and for each vector column one of values and one of lengths,
    behind which there are the distinct values if there are few.

    Rows whose ids share id // ``together`` are in one block.
    """
    small_batches(df.sparkSession)
    ids, *vectors = df.columns
    df = df.select(F.col(ids).cast("long"), *[F.col(v).cast("array<double>") for v in vectors]).where(F.col(ids).isNotNull())
    if together > 1:
        df = df.repartition(F.floor(F.col(ids) / together)).sortWithinPartitions(ids)
    names = [f"{name}_ids", *[f"{name}_{part}{i}" for i in range(len(vectors)) for part in ("values", "sizes")]]

    def flat(column: pa.ListArray, order: np.ndarray) -> tuple[bytes, bytes]:
        column = column.take(pa.array(order))
        sizes = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], np.int32)
        width = max(0, int(sizes.max(initial=0)))
        m = np.zeros((len(sizes), width))
        values = column.flatten().to_numpy(zero_copy_only=False)
        if width:
            m[np.arange(width)[None, :] < np.maximum(sizes, 0)[:, None]] = values
        values, book = _squeezed(m)
        return values, sizes.tobytes() + book

    def block(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        keys = table.column(0).to_numpy()
        order = np.argsort(keys, kind="stable")
        parts = [keys[order].astype(np.int64).tobytes()]
        for c in table.columns[1:]:
            parts += flat(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, order)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows > rows + together:
                n = rows
                if together > 1:
                    groups = held.column(0).slice(0, rows + together).to_numpy() // together
                    while n < len(groups) and groups[n] == groups[n - 1]:
                        n += 1
                    if n == len(groups):
                        n = held.num_rows  # many rows of one id: they wait for the rest
                        break
                yield block(held.slice(0, n))
                held = held.slice(n)
        if held is not None and held.num_rows:
            yield block(held)

    return df.mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES`` where they are larger: rows of many vectors, and blocks, are wide."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, most)


def meet(pool: DataFrame, queries: DataFrame, visit: Callable[[Block, Iterator[Block]], Iterator[pa.RecordBatch]], schema: str, together: int = 1, query_rows: int | None = None) -> DataFrame:
    """``visit`` of each block of ``queries`` and the blocks of one part of ``pool``, for all parts; neither side passes the driver.

    Tasks are parts of the queries times parts of the pool, so each reads a bounded share of both; a part of the pool is held in memory. With
    ``query_rows``, of which a block of the queries has so many, the pool is one part: it passes each block of the queries as a stream.
    """
    tasks = max(2, pool.sparkSession.sparkContext.defaultParallelism)
    left = packed(queries, "q", query_rows or QUERY_ROWS).withColumn("block", F.monotonically_increasing_id())
    left = left.repartition(8 * tasks if query_rows else max(2, tasks // 2))
    right = packed(pool, "p", POOL_ROWS, together).repartition(1 if query_rows else max(tasks, -(-pool.count() // PART_ROWS)))
    width = len(left.columns)

    def read(batch: pa.RecordBatch, row: int, lo: int, hi: int) -> Block:
        held = [batch.column(i)[row].as_buffer() for i in range(lo, hi)]
        keys, sides = np.frombuffer(held[0], np.int64), []
        for values, sizes in zip(held[1::2], held[2::2], strict=True):
            book, sizes = bytes(sizes[4 * len(keys) :]), np.frombuffer(sizes, np.int32, len(keys))
            sides.append((_unsqueezed(values, book, len(keys), max(0, int(sizes.max()))), sizes))
        return Block(keys, sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch, i) for batch in batches for i in range(batch.num_rows))
        # a part's rows come query block by query block
        for _, group in groupby(rows, key=lambda r: r[0].column(width - 1)[r[1]].as_py()):
            first = next(group)
            query = read(*first, 0, width - 1)

            def blocks(first=first, group=group) -> Iterator[Block]:
                yield read(*first, width, first[0].num_columns)
                for r in group:
                    yield read(*r, width, r[0].num_columns)

            yield from visit(query, blocks())

    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, schema)


def _batch(names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), OUT_ROWS):
        part = [c[lo : lo + OUT_ROWS] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=c.dtype.kind == "f") for c in part], names)


def _slack(p: Block, q: Block) -> float | None:
    """How far ``cosine_distances`` with ``fast`` may be from those without, or None where norms are so large or small that this has no bound.

    Either sum of n products is off by n / 2 ** 53 of the product of the norms at most, and the rest is a few roundings; this is twice as much.
    """
    for norms in (p.norms(0, None), q.norms(0, None)):
        live = norms[~np.isnan(norms)]
        if len(live) and not (live.min() > 1e-100 and live.max() < 1e100):
            return None
    return (min(p.cut(0, None).shape[1], q.cut(0, None).shape[1]) + 8) * 2.0**-51


def _exact_at(p: Block, q: Block, at: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The cosine distances of queries ``at`` from pool rows ``by``, summed as in ``cosine_distances``."""
    out = np.empty(len(at))
    for lo in range(0, len(at), OUT_ROWS):
        a, b = at[lo : lo + OUT_ROWS], by[lo : lo + OUT_ROWS]
        rows, cols, dot = q.cut(0, None)[a], p.cut(0, None)[b], np.zeros(len(a))
        for j in range(min(rows.shape[1], cols.shape[1])):
            dot += rows[:, j] * cols[:, j]
        with np.errstate(invalid="ignore", over="ignore"):
            out[lo : lo + OUT_ROWS] = 1 - dot / (q.norms(0, None)[a] * p.norms(0, None)[b])
        out[lo : lo + OUT_ROWS][q.sides[0][1][a] != p.sides[0][1][b]] = np.nan
    return out


Score = Callable[[Block, Block], list[np.ndarray]]


def pairs(pool: DataFrame, queries: DataFrame, score: Score, below: float | None = None, own: bool = False) -> DataFrame:
    """(cell, qid, key, dist): all pairs for each matrix of ``score``, or those under ``below``; ``own`` keeps a row with itself."""

    def visit(q: Block, blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for p in blocks:
            apart = None if own else q.keys[:, None] != p.keys[None, :]
            for cell, dist in enumerate(score(p, q)):
                keep = np.ones(dist.shape, bool) if apart is None else apart
                if below is not None:
                    keep = keep & (dist < below)
                at, by = np.nonzero(keep)
                yield from _batch(["cell", "qid", "key", "dist"], [np.full(len(at), cell, np.int32), q.keys[at], p.keys[by], dist[at, by]])

    return meet(pool, queries, visit, "cell int, qid long, key long, dist double")


def least(dist: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, k or fewer) least distances of each row and their keys, ties by key; what is no number comes last. In no order within a row."""
    if dist.shape[1] <= k:
        return dist, keys
    order = np.where(np.isnan(dist), np.inf, dist)
    limit = np.partition(order, k - 1, axis=1)[:, k - 1]
    at, by = np.nonzero(order <= limit[:, None])
    if len(at) > k * len(dist):
        sort = np.lexsort((keys[at, by], order[at, by], at))
        at, by = at[sort], by[sort]
        first = np.searchsorted(at, np.arange(len(dist)))
        keep = np.arange(len(at)) - first[at] < k
        at, by = at[keep], by[keep]
    at, by = at.reshape(len(dist), k), by.reshape(len(dist), k)
    return dist[at, by], keys[at, by]


#: Stands for a query itself among its neighbours.
OWN = np.iinfo(np.int64).max


class Nearest:
    """The ``k`` nearest of each query of a block so far, for each cell.

    Pairs that are no further than the k-th so far wait until there are some for every query; then they are put among the nearest at once.
    """

    def __init__(self, q: Block, k: int, own: bool = False) -> None:
        self.q, self.k, self.own = q, k, own
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.limit: dict[int, np.ndarray] = {}
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def _put(self, cell: int, dist: np.ndarray, keys: np.ndarray) -> None:
        if cell in self.held:
            dist, keys = np.concatenate([self.held[cell][0], dist], 1), np.concatenate([self.held[cell][1], keys], 1)
        dist, keys = self.held[cell] = least(dist, keys, self.k)
        if dist.shape[1] == self.k:
            self.limit[cell] = np.where(np.isnan(dist), np.inf, dist).max(1)

    def _settle(self, cell: int) -> None:
        some = self.waiting.pop(cell, None)
        if some:
            at, dist, keys = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.argsort(at, kind="stable")
            at = at[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            wide = (len(self.q.keys), int(place.max()) + 1)
            d, k = np.full(wide, np.nan), np.full(wide, OWN)
            d[at, place], k[at, place] = dist[order], keys[order]
            self._put(cell, d, k)

    def add(self, p: Block, scores: list[np.ndarray]) -> None:
        keys = np.broadcast_to(p.keys, (len(self.q.keys), len(p.keys)))
        mine = None if self.own else self.q.keys[:, None] == p.keys[None, :]
        if mine is not None and not mine.any():
            mine = None
        for cell, dist in enumerate(scores):
            k = keys
            if mine is not None:
                k, dist = np.where(mine, OWN, keys), np.where(mine, np.nan, dist)  # behind all others, and not handed on
            if cell in self.limit:
                at, by = np.nonzero(~(dist > self.limit[cell][:, None]))
                if len(at) <= self.k * len(self.q.keys):
                    self.waiting.setdefault(cell, []).append((at, dist[at, by], k[at, by]))
                    if sum(len(x[0]) for x in self.waiting[cell]) > self.k * len(self.q.keys):
                        self._settle(cell)
                    continue
            self._settle(cell)
            self._put(cell, *least(dist, k, self.k))

    def found(self, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, k or fewer) distances and keys of the nearest, in no order within a row; ``OWN`` stands for no row."""
        self._settle(cell)
        return self.held[cell]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for cell in list(self.held):
            dist, keys = self.found(cell)
            at, by = np.nonzero(keys != OWN)
            yield from _batch(["cell", "qid", "key", "dist"], [np.full(len(at), cell, np.int32), self.q.keys[at], keys[at, by], dist[at, by]])


#: Sums (cells, any number) over the pairs of two blocks and their scores.
Tally = Callable[[Block, Block, list[np.ndarray]], np.ndarray]


def nearest(pool: DataFrame, queries: DataFrame, score: Score, k: int, own: bool = False, tally: Tally | None = None, together: int = 1) -> DataFrame:
    """(cell, qid, key, dist): for each matrix of ``score`` and each part of the pool its ``k`` nearest of every query, ties by key.

    With ``tally`` there is a column ``sums``, and rows without ids have the sums of all pairs of a part.
    """

    def visit(q: Block, blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        best, sums = Nearest(q, k, own), None
        for p in blocks:
            scores = score(p, q)
            best.add(p, scores)
            if tally:
                more = tally(p, q, scores)
                sums = more if sums is None else sums + more
        for batch in best.rows():
            yield batch if tally is None else pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.list_(pa.float64()))], [*batch.schema.names, "sums"])
        if sums is not None:
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(list(sums.astype(float)), pa.list_(pa.float64()))], ["cell", "qid", "key", "dist", "sums"])

    return meet(pool, queries, visit, "cell int, qid long, key long, dist double" + (", sums array<double>" if tally else ""), together)


def tallied(near: DataFrame) -> DataFrame:
    """(cell, s0, s1...): the sums of a stored ``nearest`` over all parts."""
    sums = near.where("sums is not null")
    width = sums.select(F.max(F.size("sums"))).first()[0] or 0
    return sums.groupBy("cell").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])


def close_pairs(pool: DataFrame, queries: DataFrame, digits: int | None = None, below: float | None = None, own: bool = False) -> DataFrame:
    """(qid, key, dist): cosine distances of all pairs, or of those under ``below``, then rounded to ``digits``.

    The matrix product stands where it can only be rounded to the same number and lies on the same side of ``below``.
    """

    def visit(q: Block, blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for p in blocks:
            slack = _slack(p, q) if digits is not None or below is not None else None
            dist = cosine_distances(p, q, fast=slack is not None)
            keep = np.ones(dist.shape, bool) if own else q.keys[:, None] != p.keys[None, :]
            if below is not None:
                keep &= dist < below + (slack or 0)
            at, by = np.nonzero(keep)
            found = dist[at, by]
            if slack is not None:
                unsure = np.zeros(len(found), bool) if below is None else found >= below - slack
                if digits is None:
                    unsure[:] = True
                else:
                    step = np.abs(found) * 10.0**digits
                    unsure |= np.abs(step - np.floor(step) - 0.5) <= 2 * slack * 10.0**digits + np.spacing(step)
                i = np.flatnonzero(unsure)
                found[i] = _exact_at(p, q, at[i], by[i])
                if below is not None:
                    live = found < below
                    at, by, found = at[live], by[live], found[live]
            yield from _batch(["qid", "key", "dist"], [q.keys[at], p.keys[by], rounded(found, digits)])

    return meet(pool, queries, visit, "qid long, key long, dist double")


def close_nearest(pool: DataFrame, queries: DataFrame, k: int, digits: int | None = None, own: bool = False) -> DataFrame:
    """(qid, key, dist): the ``k`` nearest of every query by cosine distance, rounded to ``digits``, in each part of the pool; ties by key, what
    has no distance last.

    Only pairs that the matrix product puts no further than the k-th so far, and what it may be off, are summed from the left and kept.
    """

    def visit(q: Block, blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        n = len(q.keys)
        at, keys, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = np.full(n, np.inf)  # the k-th so far
        waiting, m = [], 0

        def settle() -> None:
            nonlocal at, keys, dist, waiting, m
            at, keys, dist = (np.concatenate([a, *b]) for a, b in zip((at, keys, dist), zip(*waiting, strict=True), strict=True))
            waiting, m = [], 0
            order = np.lexsort((keys, dist, at))
            at, keys, dist = at[order], keys[order], dist[order]
            first = np.searchsorted(at, np.arange(n))
            live = np.arange(len(at)) - first[at] < k
            at, keys, dist = at[live], keys[live], dist[live]
            first, last = np.searchsorted(at, np.arange(n)), np.searchsorted(at, np.arange(n), "right") - 1
            full = last - first + 1 == k
            limit[full] = dist[last[full]]

        for p in blocks:
            slack = _slack(p, q)
            with np.errstate(invalid="ignore"):
                fast = cosine_distances(p, q, fast=slack is not None)
            fast[np.isnan(fast)] = np.inf
            mine = None if own else q.keys[:, None] == p.keys[None, :]
            if mine is not None:
                fast[mine] = np.inf
            margin = (slack or 0) + (0 if digits is None else 10.0**-digits)
            near = fast <= (limit + 2 * margin)[:, None]
            if np.count_nonzero(near) > 4 * k * n and fast.shape[1] > k:  # limits are still wide
                most = np.minimum(limit, np.partition(fast, k - 1, axis=1)[:, k - 1])
                near = fast <= (most + 2 * margin)[:, None]
            if mine is not None:
                near &= ~mine
            i, j = np.nonzero(near)
            if not len(i):
                continue
            new = fast[i, j] if slack is None else _exact_at(p, q, i, j)
            new = rounded(new, digits)
            waiting.append((i, p.keys[j], np.where(np.isnan(new), np.inf, new)))
            m += len(i)
            if 2 * m > k * n:  # some for every query
                settle()
        if waiting:
            settle()
        yield from _batch(["qid", "key", "dist"], [q.keys[at], keys, np.where(np.isinf(dist), np.nan, dist)])

    return meet(pool, queries, visit, "qid long, key long, dist double")


def beside(pool: DataFrame, queries: DataFrame, score: Score, names: list[str]) -> DataFrame:
    """(qid, key, names...): all pairs but those of a row with itself, with a distance for each matrix of ``score``."""

    def visit(q: Block, blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for p in blocks:
            at, by = np.nonzero(q.keys[:, None] != p.keys[None, :])
            yield from _batch(["qid", "key", *names], [q.keys[at], p.keys[by], *[s[at, by] for s in score(p, q)]])

    return meet(pool, queries, visit, "qid long, key long, " + ", ".join(f"{n} double" for n in names))

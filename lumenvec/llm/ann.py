"""Approximate nearest neighbours by cosine: inverted lists, scanned in column blocks of rotated vectors with early abandoning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenvec.llm.common import materialize

#: Rows that centroids and number of probes are fitted on, and their bytes as float32, at most; every row is indexed.
FIT_ROWS, FIT_BYTES = 50_000, 64 << 20
#: Of these, rows that give each query its first bound on the distance to beat.
BOUND_ROWS = 4_096
#: Rows of a list that more lists are made for, as long as each has so many rows of the sample, and lists at most.
LIST_ROWS, LIST_SAMPLE, MOST_LISTS = 512, 8, 16_384
#: Rows and queries of one scan, and queries of one matrix in it.
SCAN_ROWS, SCAN_QUERIES, SCAN_STEP = 8_192, 8_192, 1_024
COLUMN_BLOCK = 16


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that squares of very large and small components stay finite; angles don't change."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True, initial=1e-300))[1])


def _kmeans(unit: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; beyond 256 centroids in two levels, each cell of the first with a share of centroids by its rows."""
    if k > 256:
        cells = _kmeans(unit, int(round(k**0.5)), rng, rounds)
        home = _nearest(unit, cells)
        upto = np.cumsum(np.bincount(home, minlength=len(cells))) * k // len(unit)
        return np.concatenate([_kmeans(unit[home == c], n, rng, rounds) for c, n in enumerate(np.diff(upto, prepend=0).tolist()) if n])
    centroids = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(rounds if k > 1 else 0):
        near = _nearest(unit, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centroids).astype(np.float32)
    return centroids


class Index:
    """What the fit leaves: rotation, centroids, number of probes; small, and shipped with the tasks."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, target: float = 0.98, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        unit = self.unit(sample)
        self.bound_rows = unit[:BOUND_ROWS]
        lists = int(max(1, min(MOST_LISTS, len(unit) // LIST_SAMPLE, max(round(rows**0.5), rows // LIST_ROWS))))
        self.centroids = _kmeans(unit, lists, rng)
        self.probes = self._calibrate(unit, k, target, rng)

    def _calibrate(self, unit: np.ndarray, k: int, target: float, rng) -> int:
        """The fewest probes whose lists hold ``target`` of the true neighbours of sampled queries, found exactly among the sample."""
        ask = rng.choice(len(unit), min(500, len(unit)), replace=False)
        true = np.concatenate([self._neighbours(unit, ask[i : i + 25], k) for i in range(0, len(ask), 25)])  # in steps: a row of scores is as long as the sample
        home = _nearest(unit, self.centroids)
        order = np.argsort(-(unit[ask] @ self.centroids.T), axis=1)
        rank = np.argsort(order, axis=1)
        need = np.sort(rank[np.arange(len(ask))[:, None], home[true]].ravel())
        return int(need[min(len(need) - 1, int(np.ceil(target * len(need))))]) + 1

    @staticmethod
    def _neighbours(unit: np.ndarray, ask: np.ndarray, k: int) -> np.ndarray:
        scores = unit[ask] @ unit.T
        scores[np.arange(len(ask)), ask] = -2
        return np.argpartition(-scores, min(k, len(unit) - 1) - 1, axis=1)[:, :k] if len(unit) > 1 else np.zeros((1, 1), np.int64)

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        v = _scaled(vectors)
        return ((v / np.linalg.norm(v, axis=1, keepdims=True)) @ self.rotation).astype(np.float32)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def scan(queries: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int, block: int = COLUMN_BLOCK, epsilon: float = 2.1) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that are not abandoned, of rotated unit vectors, with ``bound`` the squared distance each query has to beat.

    Column block by column block, the partial distance over d of D columns estimates the whole as D / d times itself. The hypothesis that
    the row is near enough is rejected, and the row abandoned, if the estimate exceeds bound * (1 + epsilon / sqrt(d))**2; after the last
    column the distance is exact. Only pairs still open are added up once they are few.
    """
    dim = rows.shape[1]
    q, r = np.zeros(0, np.int64), np.zeros(0, np.int64)
    part, open_ = np.zeros((len(queries), len(rows)), np.float32), None
    for lo in range(0, dim, block):
        hi = min(dim, lo + block)
        a, b = queries[:, lo:hi], rows[:, lo:hi]
        limit = bound * ((1 + epsilon / hi**0.5) ** 2 if hi < dim else 1) * (hi / dim if hi < dim else 1) + 1e-5
        if open_ is None:
            part += (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
            alive = part <= limit[:, None]
            if alive.mean() < 0.2 or hi == dim:
                q, r = np.nonzero(alive)
                open_ = part[q, r]
        else:
            gap = a[q] - b[r]
            open_ += (gap * gap).sum(1)
            keep = open_ <= limit[q]
            q, r, open_ = q[keep], r[keep], open_[keep]
    return q, r


def _assign(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            near = _nearest(index.unit(v), index.centroids) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near.astype(np.int32))], ["cls", "vector", "ids", "list"])

    return run


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _probe(index: Index, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = index.unit(_matrix(b.column(1)))
            lists = np.argsort(-(u @ index.centroids.T), axis=1)[:, : index.probes]
            near = np.full(len(u), 4.0)
            if len(index.bound_rows) >= k:
                near = 2 - 2 * np.partition(u @ index.bound_rows.T, -k, axis=1)[:, -k].astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(near)], ["cls", "vector", "lists", "bound"])

    return run


def _scan_blocks(index: Index, k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        rows, asks = _scaled(np.stack(right["vector"]).astype(np.float64)), _scaled(np.stack(left["vector"]).astype(np.float64))
        units, bound, cls = index.unit(rows), left["bound"].to_numpy(np.float32), right["cls"].to_numpy()
        rn, qn = np.linalg.norm(rows, axis=1), np.linalg.norm(asks, axis=1)
        out = []
        for lo in range(0, len(asks), SCAN_STEP):
            q, r = scan(index.unit(asks[lo : lo + SCAN_STEP]), units, bound[lo : lo + SCAN_STEP], k)
            q += lo
            score = np.concatenate([np.einsum("ij,ij->i", asks[q[i : i + 65536]], rows[r[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)]) / (qn[q] * rn[r])
            best = np.lexsort((cls[r], -score, q))
            q, r, score = q[best], r[best], score[best]
            place = np.arange(len(q)) - np.searchsorted(q, q, "left")
            top = place < k  # of equal scores those of the least ids, which settle ties
            out.append(pd.DataFrame({"query": left["cls"].to_numpy()[q[top]], "cls": cls[r[top]], "score": score[top]}))
        return pd.concat(out)

    return run


def _search(listed: DataFrame, probes: DataFrame, index: Index, k: int) -> DataFrame:
    """(query, cls, score): the best of each block of a list for each query (cls, vector, bound) that probes the list."""
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / SCAN_ROWS).cast("int").alias("nc")).join(probes.groupBy("list").agg(F.ceil(F.count("*") / SCAN_QUERIES).cast("int").alias("nq")), "list")
    sizes = F.broadcast(sizes)  # at most MOST_LISTS rows
    right = listed.select("cls", "vector", "list").join(sizes, "list").withColumn("c", F.pmod(F.xxhash64("cls"), "nc").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("list", "c", "q", "cls", "vector")
    left = probes.join(sizes, "list").withColumn("q", F.pmod(F.xxhash64("cls"), "nq").cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).select("list", "c", "q", "cls", "vector", "bound")
    return left.groupBy("list", "c", "q").cogroup(right.groupBy("list", "c", "q")).applyInPandas(_scan_blocks(index, k), "query long, cls long, score double")


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its ``k`` nearest other rows that the search finds.

    Nearest first by cosine in double precision on the original vectors, ties by smaller id. Equal vectors are one class, searched once,
    that stands for its k + 1 smallest ids; more of them can't be among k results, so one vector in a third of all rows costs no more.

    Plan: rows are listed under the nearest centroid, of rotated unit vectors; a query scans its own list first, with a bound on the
    distance to beat from a sample, then the other lists that it probes with the bound tightened to what the first gave. Candidates are
    abandoned column block by column block (``scan``). Queries that find fewer than ``k`` others, as where the rows that gave the bound
    lie in lists that aren't probed, scan all lists without a bound. Lists are cut into runs of bounded size, and so are the queries
    that probe them, so no list meets in one task.

    The fit uses a bounded sample (``FIT_ROWS``, ``FIT_BYTES``). Lists are as many as the root of the rows, beyond 262,144 rows as many as
    give each ``LIST_ROWS``, while the sample has ``LIST_SAMPLE`` rows for each and up to ``MOST_LISTS``; from there on lists grow with
    the table, and with them what a query costs. Vectors that are null or zero, or hold null or non-finite components, take no part; neither
    do those of another dimension than most. Rows with a null id are left out; rows with the same id count once, those with different vectors
    by the vector of the least hash. An empty table
    gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    v = F.col("vector")
    fine = "vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null").where(fine)
    rows = rows.withColumn("digest", F.xxhash64(v)).groupBy("vec_id").agg(F.min_by("vector", "digest").alias("vector"), F.min("digest").alias("digest"))
    dim = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    shape = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return spark.createDataFrame([], shape)
    rows = rows.where(F.size("vector") == dim.d)
    order = Window.partitionBy("digest", "vector").orderBy("vec_id")
    small = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    classes = materialize(small.groupBy("digest", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cls"), "vector", "ids"), "classes")
    asked = materialize(rows.where(F.col("vec_id") % every == 0).join(classes.select(F.xxhash64("vector").alias("digest"), "vector", "cls"), ["digest", "vector"]).select("vec_id", "cls"), "asked")
    count = classes.count()
    fit_rows = min(FIT_ROWS, max(1, FIT_BYTES // (4 * dim.d)))
    sample = classes.orderBy(F.xxhash64(F.lit(seed), "cls"), "cls").limit(fit_rows).select("vector").toArrow().column(0).combine_chunks()
    index = Index(_matrix(sample), count, k + 1, seed=seed)
    listed = materialize(classes.mapInArrow(_assign(index), "cls long, vector array<double>, ids array<long>, list int"), "lists")
    heads = asked.select("cls").distinct()
    probes = materialize(classes.join(heads, "cls", "left_semi").select("cls", "vector").mapInArrow(_probe(index, k + 1), "cls long, vector array<double>, lists array<int>, bound double"), "probes")
    level = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    best = lambda found: found.withColumn("rn", F.row_number().over(level)).where(F.col("rn") <= k + 1).select("query", "cls", "score")
    first = materialize(best(_search(listed, probes.select("cls", "vector", "bound", F.element_at("lists", 1).alias("list")), index, k + 1)), "first")
    tight = first.groupBy(F.col("query").alias("cls")).agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") > k).select("cls", (2 - 2 * F.col("last")).alias("tight"))
    others = probes.join(tight, "cls", "left").select("cls", "vector", F.least("bound", "tight").alias("bound"), F.explode(F.slice("lists", F.lit(2), F.size("lists"))).alias("list"))
    found = materialize(best(first.unionByName(_search(listed, others, index, k + 1))), "found")
    names = listed.select("cls", "ids")
    got = probes.select(F.col("cls").alias("query")).join(found.join(names, "cls").groupBy("query").agg(F.sum(F.size("ids")).alias("ids"), F.count("*").alias("n")), "query", "left")
    short = materialize(got.where((F.coalesce("ids", F.lit(0)) <= k) & (F.coalesce("n", F.lit(0)) < count)).select(F.col("query").alias("cls")), "short")
    if not short.isEmpty():
        wide = probes.join(short, "cls", "left_semi").select("cls", "vector", F.lit(4.0).alias("bound"), F.explode(F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))).alias("list"))
        rest = found.join(short.withColumnRenamed("cls", "query"), "query", "left_anti")
        found = best(rest.unionByName(_search(listed, wide, index, k + 1)))
    wide = found.join(names, "cls").join(asked.select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query")), "query")
    pairs = wide.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

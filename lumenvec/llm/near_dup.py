"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets and union-find grouping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.llm import kernels as K
from lumenvec.llm.common import drop_scratch, free_name, hot_keys, join_hot, materialize, maybe_broadcast, python_tasks, small_batches
from lumenvec.llm.components import LOCAL_EDGES, UnionFind, connected_components

#: Documents of one comparison block, and shingles of their sets together.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
#: Rows of a task that compares signatures of buckets, and of one that compares full sets.
BUCKET_TASK, SET_TASK = 20_000, 2_000


def _signatures(width: int, bands: int, rows: int, seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi in K.pieces(offsets):
                sets = K.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                sig = K.superminhash(sets, bands * rows, seed)
                keys = K.band_keys(sig, bands, rows).view(np.int64)
                short = K.mix(sig).astype(np.uint8)
                n = np.array([len(s) for s in sets], np.int64)
                d1 = np.array([int(s.sum(dtype=K.U)) for s in sets], K.U).view(np.int64)
                d2 = np.array([int(K.mix(s).sum(dtype=K.U)) for s in sets], K.U).view(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(n), pa.array(d1), pa.array(d2), pa.array([x.tobytes() for x in short], pa.binary()), listed], schema=schema)
        K.release()

    return run


def _whole(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of whole groups of rows that arrive sorted by ``keys``; a batch and one group more are in memory at a time."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        other = np.flatnonzero((k != k[-1]).any(1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pd.concat([*held, pdf.iloc[:cut]])
            held = []
        elif held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held)
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held)


def _ends(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where groups begin in sorted rows, and their end."""
    k = pdf[keys].to_numpy()
    return np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, len(pdf)]


#: (payloads, set sizes, left places, right places, whether both are one group) to the places of the pairs that are alike.
Test = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray]]
#: Groups up to so many rows, most of all, are tested together where the test has a form for pairs.
SMALL_GROUP = 32


class Signatures:
    """The test that signatures agree in a share of ``least`` of their places, and that the sizes allow a similarity of ``ratio``."""

    def __init__(self, least: float, ratio: float) -> None:
        self.least, self.ratio = least, ratio

    def pairs(self, sig: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        fits = np.minimum(n[x], n[y]) >= self.ratio * np.maximum(n[x], n[y])
        fits[fits] = (sig[x[fits]] == sig[y[fits]]).sum(1) >= self.least * sig.shape[1]
        return fits

    def __call__(self, payloads, n, left, right, within):
        sig = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), -1)
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in left.tolist():
            others = right[right > x] if within else right
            hit = others[self.pairs(sig, n, np.full(len(others), x), others)]
            xs.append(np.full(len(hit), x))
            ys.append(hit)
        return np.concatenate(xs), np.concatenate(ys)


def _sets_overlap(percent: int) -> Test:
    """100 * intersection >= percent * union of full shingle sets."""

    def test(payloads, n, left, right, within):
        both = _overlaps([np.frombuffer(p, K.U) for p in payloads], left, right).astype(np.int64)
        union = n[left][:, None] + n[right][None, :] - both
        x, y = np.nonzero((100 * both >= percent * union) & (both > 0))
        return left[x], right[y]

    return test


#: Columns of the rows that are compared: group, member, size of its set, signature or set. Blocks add ``i`` and ``j``, the numbers of the
#: left and right block, and ``side``.
MEMBER = "g long, id long, n long, payload binary"


def _links(test: Test):
    """Pairs that are alike within each group (side -1) or between the sides of a pair of blocks, as the edges of a task's spanning forest."""
    keys = ["g", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joined = UnionFind()
        for pdf in _whole(batches, keys):
            ends = _ends(pdf, keys)
            size = np.diff(ends)
            ids, side, n = pdf["id"].to_numpy(), pdf["side"].to_numpy(), pdf["n"].to_numpy()
            found = []
            together = (size <= SMALL_GROUP) & (side[ends[:-1]] == -1) & isinstance(test, Signatures)
            if together.any():
                sig = np.frombuffer(b"".join(pdf["payload"]), np.uint8).reshape(len(pdf), -1)
                group = np.repeat(np.where(together, np.arange(len(size)), -1 - np.arange(len(size))), size)
                for d in range(1, int(size[together].max())):
                    x = np.flatnonzero((group[d:] == group[:-d]) & (group[d:] >= 0))
                    x = x[test.pairs(sig, n, x, x + d)]
                    found.append((x, x + d))
            for lo, hi in zip(ends[:-1][~together].tolist(), ends[1:][~together].tolist(), strict=True):
                within = side[lo] == -1
                left, right = (np.arange(hi - lo),) * 2 if within else (np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1))
                if len(left) and len(right):
                    x, y = test(pdf["payload"].iloc[lo:hi].tolist(), n[lo:hi], left, right, within)
                    found.append((x + lo, y + lo))
            new = [(p, q) for x, y in found for p, q in zip(ids[x].tolist(), ids[y].tolist(), strict=True) if p != q and joined.union(p, q)]
            if new:
                yield pd.DataFrame(new, columns=["a", "b"], dtype="int64")
            if len(joined.up) > LOCAL_EDGES:
                joined = UnionFind()
        K.release()

    return run


def _stars(test: Test):
    """(g, id, n, payload, head, linked): whether each member (side 1) of a block is like its group's head (side 0)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(batches, ["g", "i", "j"]):
            ends = _ends(pdf, ["g", "i", "j"])
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                g = pdf.iloc[lo:hi]
                side = g["side"].to_numpy()
                head, members = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if len(head) and len(members):
                    linked = np.zeros(len(g), bool)
                    linked[test(g["payload"].tolist(), g["n"].to_numpy(), head, members, False)[1]] = True
                    yield g[["g", "id", "n", "payload"]].assign(head=g["id"].iloc[head[0]], linked=linked).iloc[members]
        K.release()

    return run


def _spread(c: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(c, "n"), F.col(blocks)).cast("int")


def _upto(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))


def _compare(rows: DataFrame, test: Test, tasks: int, weight: int) -> DataFrame:
    """(a, b): links between the ``MEMBER`` rows of each group that leave its components as if all pairs had been compared.

    A group within ``BLOCK_ROWS`` rows and ``weight`` elements of all its sets is one comparison. In a larger one every member is compared
    with the head, the member of the least id; then the rest, those that aren't like it, with all, in pairs of blocks. What a group costs
    is its size times the blocks of its rest: near copies of one text have little rest. No group meets in one task.
    """
    sizes = rows.groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min("id").alias("head"))
    sizes = materialize(sizes.where("c > 1").select("g", "c", "head", F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("w") / weight)).cast("int").alias("blocks")), "sizes")
    grouped = lambda df, what, shape: df.repartition(tasks, "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInPandas(what, shape)
    hot = hot_keys(sizes, rows.count())
    joined = join_hot(rows, sizes, ["g"], hot)
    small = grouped(joined.where("blocks = 1").select("g", "id", "n", "payload", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side")), _links(test), "a long, b long")
    if sizes.where("blocks > 1").isEmpty():
        return small
    large = joined.where("blocks > 1")
    member = large.select("g", "id", "n", "payload", _spread("id", "blocks").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"))
    first = large.where("id = head").groupBy("g", "blocks").agg(F.min(F.struct("id", "n", "payload")).alias("h")).select("g", "h.*", _upto("blocks").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    star = materialize(grouped(member.unionByName(first), _stars(test), f"{MEMBER}, head long, linked boolean"), "stars")
    edges = small.unionByName(star.where("linked").select(F.col("id").alias("a"), F.col("head").alias("b")))
    blocks = lambda kept, n: star.where(kept).groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / weight)).cast("int").alias(n))
    plan = materialize(blocks("not linked", "nr").join(blocks("true", "na"), "g"), "blocks")
    if plan.isEmpty():
        return edges
    placed = join_hot(star, plan, ["g"], hot)
    left = placed.where("not linked").select("g", "id", "n", "payload", _spread("id", "nr").alias("i"), _upto("na").alias("j"), F.lit(0).alias("side"))
    right = placed.select("g", "id", "n", "payload", _upto("nr").alias("i"), _spread("id", "na").alias("j"), F.lit(1).alias("side"))
    return edges.unionByName(grouped(left.unionByName(right), _links(test), "a long, b long"))


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets left x right, from products of 0/1 matrices over slices of the shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    dense = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    owner, col = owner[keep], dense[inverse[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(col):
        return out
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    step = max(256, min(4096, 8_000_000 // len(sets)))
    for lo in range(0, int(col[-1]) + 1, step):
        s = slice(*np.searchsorted(col, [lo, lo + step]))
        bits = np.zeros((len(sets), step), np.float32)
        bits[owner[s], col[s] - lo] = 1
        out += bits[left] @ bits[right].T
    return out


def _full_sets(width: int):
    """Whole texts to full shingle sets, as sorted 64-bit numbers."""
    schema = pa.schema([("g", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            for lo, hi in K.pieces(offsets):
                sets = K.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)
        K.release()

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = 32, rows: int = 5, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct ``width``-word shingles (ASCII white
    space separates words, A-Z count as a-z; a text of fewer words is one shingle). Components are those of the graph of all links.

    Plan: (1) one Arrow pass makes set digests, SuperMinHash signatures and band keys; equal sets become one class under its least id;
    (2) keys that two classes share make buckets, whose members are joined to candidate clusters where signatures agree to 5.5 standard
    deviations below the limit; (3) clusters are verified on the full sets of their whole texts; (4) components of the confirmed links.
    Within a bucket or cluster, members are compared with a head first, and only what isn't like it with all others, block by block
    (``_compare``), so that no group meets in one task and a group of near copies costs its size; nothing goes to the driver but counts.
    The chance that banding misses a pair at the limit is (1 - J**rows)**bands, 4e-6 at J = 0.8 and 7e-9 at 0.85 by default.

    Null and empty texts have no shingles, are linked with nothing and are kept. Rows that share a doc_id are one document in the graph
    and share its fate; rows that repeat it with the same set are compared once. A null doc_id can't be named by a component: its
    component is its class's, if any other row has one, and it is kept only if there is none. An empty table gives an empty result; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = materialize(source.mapInArrow(_signatures(width, bands, rows, seed), "doc_id long, n long, d1 long, d2 long, sig binary, keys array<long>"), "marks")
    body = ["n", "d1", "d2"]
    classes = materialize(marks.where("n > 0").groupBy(*body).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.count("*").alias("c")), "classes")
    banded = materialize(classes.where("rep is not null").select("rep", F.explode("keys").alias("key")).distinct(), "bands")
    shared = materialize(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    members = join_hot(banded, shared.select("key"), ["key"], hot_keys(shared, banded.count())).join(classes.select("rep", "n", "sig"), "rep")
    members = materialize(members.select(F.col("key").alias("g"), F.col("rep").alias("id"), "n", F.col("sig").alias("payload")), "members")
    limit = percent / 100
    least = limit - 5.5 * (limit * (1 - limit) / (bands * rows)) ** 0.5
    clusters = connected_components(_compare(members, Signatures(least, limit), python_tasks(spark, members.count(), BUCKET_TASK), 2**62))
    heads = clusters.select(F.col("component").alias("id"), F.col("component").alias("g")).distinct()
    inside = materialize(clusters.select(F.col("node").alias("id"), F.col("component").alias("g")).unionByName(heads), "inside")
    texts = source.withColumnRenamed("doc_id", "id").join(maybe_broadcast(inside, inside.count()), "id").select("g", "id", "text")
    sets = materialize(texts.mapInArrow(_full_sets(width), MEMBER).withColumn("h", F.xxhash64("payload")).dropDuplicates(["id", "n", "h"]).drop("h"), "sets")
    found = connected_components(_compare(sets, _sets_overlap(percent), python_tasks(spark, sets.count(), SET_TASK), BLOCK_SHINGLES))
    named = materialize(classes.select(*body, "rep", "c").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*body, "c", F.coalesce("component", "rep").alias("group")), "named")
    drop_scratch(classes, banded, shared, members, clusters, inside, sets, found)
    out = marks.select("doc_id", *body)
    whole = join_hot(out.where("n > 0"), named.drop("c"), body, hot_keys(named, marks.count())).unionByName(out.where("n = 0").withColumn("group", F.lit(None).cast("long")))
    component = F.coalesce("group", "doc_id")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` with one row of each component of near duplicates; every column stays as it is.

    Rows are judged each on its own, under a written row number: rows of one id may fall to different components, and null ids are like any
    other. A component keeps the row of its least id (nulls last), the first written of these. Rows without shingles (null, empty and
    blank texts) all stay. An empty table gives an empty one.
    """
    row = free_name(docs, "__row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    marks = materialize(near_duplicates(numbered, percent, id_col=row, **more).select(F.col("doc_id").alias(row), F.col("component_id").alias("__component")), "components")
    joint = materialize(marks.groupBy("__component").agg(F.count("*").alias("c")).where("c > 1"), "joint")
    members = materialize(join_hot(marks, joint.select("__component"), ["__component"], hot_keys(joint, marks.count())), "members")
    place = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    first = numbered.select(row, id_col).join(members, row).groupBy("__component").agg(F.min(place).alias("__first")).select(F.col("__first.row").alias(row))
    gone = materialize(members.select(row).join(first, row, "left_anti"), "gone")
    drop_scratch(marks, joint, members)
    return numbered.join(maybe_broadcast(gone, gone.count()), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

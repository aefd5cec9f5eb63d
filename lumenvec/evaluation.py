"""Queries of the catalogue on search quality: codecs, truncated grids, overlaps and rank correlations, over queries with ids divisible by 100."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.catalogue import ASKED, _asked, _df, _pool, _table
from lumenvec.exchange import scratch
from lumenvec.functions import codec, quant, vec
from lumenvec.operators import blocks, ranks, search
from lumenvec.studies import _cut

DIM = 64

# SQL of the same: rotated vectors, codes and queries
_FLIPS = f"cast({vec.signs(DIM)} as double[])"
_ROT = f"rot as (select vec_id, cast(embedding as double[]) as e, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 64), lambda j: cast(embedding[j + 1] as double) * {_FLIPS}[j + 1] * (case when bit_count(cast(i & j as bigint)) % 2 = 0 then 1 else -1 end))) / 8) as r from embeddings)"


def _word(v: str, w: int, test: str) -> str:
    """SQL for word ``w`` of the bits ``test`` (of x) of a list ``v``."""
    return f"cast(list_sum(list_transform(range(0, 32), lambda j: case when {test.replace('x', f'{v}[j + {1 + 32 * w}]')} then (cast(1 as bigint) << j) else 0 end)) as bigint)"


def _count(masks: list[str]) -> str:
    return "(" + " + ".join(f"cast(bit_count({m}) as integer)" for m in masks) + ")"


def _over(masks: list[str]) -> str:
    planes = " + ".join(f"{2**b} * {_count([f'({m} & q.p{b}[{w + 1}])' for w, m in enumerate(masks)])}" for b in range(4))
    return f"(q.lo * {_count(masks)} + q.step * ({planes}))"


_SIGN, _LARGE, _BOTH = ["c.s[1]", "c.s[2]"], ["c.m[1]", "c.m[2]"], ["(c.s[1] & c.m[1])", "(c.s[2] & c.m[2])"]
_SIGNED = f"(2 * {_over(_SIGN)} - q.total)"
_CODES = f"""{_ROT}, sized as (select *, sqrt(list_inner_product(r, r)) as n, sqrt(list_inner_product(r, r)) * {codec.CUT} / 8 as cut from rot),
c as (select *, [{_word('r', 0, 'x >= 0')}, {_word('r', 1, 'x >= 0')}] as s, [{_word('r', 0, 'abs(x) > cut')}, {_word('r', 1, 'abs(x) > cut')}] as m,
  n / list_sum(list_transform(r, lambda x: abs(x))) as one, n / list_sum(list_transform(r, lambda x: abs(x) * (case when abs(x) > cut then {codec.LARGE} else {codec.SMALL} end))) as two from sized),
u as (select vec_id, e, n, list_sum(r) as total, list_min(r) as lo, (list_max(r) - list_min(r)) / 15 as step, list_transform(r, lambda x: cast(floor((x - list_min(r)) / ((list_max(r) - list_min(r)) / 15) + 0.5) as bigint)) as l from c where {ASKED}),
q as (select *, {', '.join(f"[{_word('l', 0, f'(x >> {b}) & 1 = 1')}, {_word('l', 1, f'(x >> {b}) & 1 = 1')}] as p{b}" for b in range(4))} from u),
coded as (select q.vec_id as qid, c.vec_id as key, list_cosine_distance(c.e, q.e) as dist, 1 - c.one * {_SIGNED} / q.n as d1, 1 - c.two * ({codec.SMALL} * {_SIGNED} + {codec.LARGE - codec.SMALL} * (2 * {_over(_BOTH)} - {_over(_LARGE)})) / q.n as d2 from c, q where c.vec_id <> q.vec_id),
cand as (select *, row_number() over (partition by qid order by round(d1, 9), key) as c1, row_number() over (partition by qid order by round(d2, 9), key) as c2, row_number() over (partition by qid order by dist, key) as t from coded)"""


def coded(pool: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sides of blocks: vectors, signs, magnitudes (0 or 1) and factors of the pool's codes; vectors, levels and (lo, step, sum, norm) of the queries."""
    bit = lambda words: F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.call_function("shiftright", F.get(words, F.floor(i / codec.WORD).cast("int")), i % codec.WORD).bitwiseAND(F.lit(1).cast("long")).cast("double"))
    p = pool.select("key", "vec", codec.encode(F.col("vec"), DIM).alias("c"))
    q = queries.select("qid", "ref", codec.prepare(F.col("ref"), DIM).alias("c"))
    scaled = lambda values, by: F.transform(values, lambda v: v * by)
    planes = [bit(F.col("c.planes")[b]) for b in range(codec.PLANES)]
    levels = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [scaled(x, 2.0**b) for b, x in enumerate(planes)])
    held = p.select("key", "vec", bit(F.col("c.s")).alias("s"), bit(F.col("c.m")).alias("m"), F.array("c.one", "c.two").alias("f"))
    return held, q.select("qid", "ref", levels.alias("l"), F.array("c.lo", "c.step", "c.sum", "c.norm").alias("h"))


def code_distances(p: blocks.Block, q: blocks.Block, bits: int) -> np.ndarray:
    """(queries, pool) distances as ``codec.cosine`` estimates them, of blocks of ``coded``; not a number for zero vectors."""
    sign, large = p.cut(1, None), p.cut(2, None)
    if not sign.shape[1] or not q.cut(1, None).shape[1]:
        return np.full((len(q.keys), len(p.keys)), np.nan)
    levels, (lo, step, total, norm) = q.cut(1, None), (x[:, None] for x in q.cut(2, None).T)
    over = lambda mask: lo * mask.sum(1) + step * (levels @ mask.T)
    one, two = (np.where(p.sides[1][1] < 0, np.nan, x)[None, :] for x in p.cut(3, None).T)
    signed = 2 * over(sign) - total
    with np.errstate(invalid="ignore", divide="ignore"):
        size = np.where((norm == 0) | (q.sides[1][1] < 0)[:, None], np.nan, norm)
        cosine = one * signed / size if bits == 1 else two * (codec.SMALL * signed + (codec.LARGE - codec.SMALL) * (2 * over(sign * large) - over(large))) / size
    return 1 - cosine


def codes(bits: int):
    """Estimated distances (qid, key, dist) from the codec of so many bits."""

    def score(pool: DataFrame, queries: DataFrame) -> DataFrame:
        return blocks.pairs(*coded(pool, queries), lambda p, q: [blocks.rounded(code_distances(p, q, bits), 9)]).select("qid", "key", "dist")

    return score


@_df("ve22_codec", f"with {_CODES} select qid, key, round(d1, 6) as one_bit, round(d2, 6) as two_bits from coded")
def _(spark, d):
    """Every query's distances from all vectors as their codes of one and two bits a coordinate estimate them."""
    coded = _pool(spark, d).select("key", codec.encode(F.col("vec"), DIM).alias("code"))
    asked = _asked(spark, d).select("qid", codec.prepare(F.col("ref"), DIM).alias("query"))
    return search.pair_up(coded, asked).select("qid", "key", *[F.round(1 - codec.cosine(F.col("code"), F.col("query"), b, DIM), 6).alias(n) for b, n in ((1, "one_bit"), (2, "two_bits"))])


@_df("se04_two_stage", f"with {_CODES}, r as (select qid, key, row_number() over (partition by qid order by t) as rank from cand where c1 <= 50) select qid, key, cast(rank as integer) as rank from r where rank <= 10")
def _(spark, d):
    """One-bit codes find 50 candidates, exact distances the ten nearest of them."""
    return search.two_stage(_pool(spark, d), _asked(spark, d), 10, 5, codes(1)).select("qid", "key", "rank")


_GRID = "select k.k, m.m from (values (10), (100), (1000)) k(k) cross join (values (1), (5), (10)) m(m)"


@_df("rp03_codec_recall", f"with {_CODES}, per as (select codec, k, m, qid, count_if(c <= k * m and t <= k) * 1e0 / count_if(t <= k) as r from (select qid, 1 as codec, c1 as c, t from cand union all select qid, 2, c2, t from cand) x cross join ({_GRID}) g group by codec, k, m, qid) select codec as bits, k, m as multiplier, k * m as candidates, codec * 8 as code_bytes, round(avg(r), 6) as recall from per group by codec, k, m")
def _(spark, d):
    """Recall at k after rescoring k * multiplier candidates of each codec: the true neighbours among the candidates are those found. Both
    codecs score a pair of blocks at once."""
    pool, asked = _pool(spark, d), _asked(spark, d)
    truth = search.exact(pool, asked, 1000).select("qid", "key", F.col("rank").alias("t"))
    near = search.many(*coded(pool, asked), lambda p, q: [blocks.rounded(code_distances(p, q, b), 9) for b in (1, 2)], 2, 10_000)
    found = search.top_k(near, 10_000, by=("cell", "qid")).select((F.col("cell") + 1).alias("bits"), "qid", "key", F.col("rank").alias("c"))
    met = truth.crossJoin(F.broadcast(spark.range(1, 3).select(F.col("id").cast("int").alias("bits")))).join(found, ["bits", "qid", "key"], "left")
    grid = spark.createDataFrame([(k, m) for k in (10, 100, 1000) for m in (1, 5, 10)], "k int, multiplier int")
    per = met.join(F.broadcast(grid), F.col("t") <= F.col("k")).groupBy("bits", "k", "multiplier", "qid").agg(F.avg((F.coalesce("c", F.lit(2**31 - 1)) <= F.col("k") * F.col("multiplier")).cast("double")).alias("r"))
    return per.groupBy("bits", "k", "multiplier").agg(F.round(F.avg("r"), 6).alias("recall")).select("bits", "k", "multiplier", (F.col("k") * F.col("multiplier")).alias("candidates"), (F.col("bits") * 8).alias("code_bytes"), "recall")


_PAIRED = f"pairs as (select q.vec_id as qid, p.vec_id as key, list_cosine_distance(cast(p.embedding as double[]), cast(q.embedding as double[])) as dist from embeddings p, embeddings q where {ASKED.replace('vec_id', 'q.vec_id')} and p.vec_id <> q.vec_id), truth as (select *, row_number() over (partition by qid order by dist, key) as t from pairs)"


@_df("rp01_truth", f"with {_PAIRED} select qid, list(key order by t) filter (t <= 10) as truth10, list(key order by t) filter (t <= 100) as truth100 from truth group by qid")
def _(spark, d):
    """Queries with their true neighbours, nearest first."""
    near = search.exact(_pool(spark, d), _asked(spark, d), 100)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"])
    return near.groupBy("qid").agg(listed.alias("truth100")).select("qid", F.slice("truth100", 1, 10).alias("truth10"), "truth100")


# Truncated grids
_COMPAND = "round(127 * ((exp({x} * 8) - 1) / (exp({x} * 8) + 1)))"


def _middle(bits: int) -> str:
    """DuckDB text of coordinate ``x`` as int8, cut to its upper ``bits``, back in the middle of its codes."""
    step = 1 << (8 - bits)
    q = _COMPAND.format(x="x")
    q = f"(floor({q} / {step}) * {step} + {step / 2})" if bits < 8 else q
    return f"(2 * atanh(greatest(-127e0, least(127e0, {q})) / 127.5e0))"


def _masked(bits: int) -> str:
    return f"(cast({_COMPAND.format(x='x')} as bigint) & {-(1 << (8 - bits))})"


#: (type, bits, coordinates): the cells of the grid.
CELLS = [(t, b, n) for t, bits in (("bf16", (2, 4, 8, 12, 16)), ("bf16_rotated", (4, 8, 16)), ("int8", (1, 4, 8)), ("int8_rotated", (1, 4, 8))) for b in bits for n in (32, 64)]


def _cell_sql(t: str, bits: int, dims: int) -> str:
    base = "r" if t.endswith("rotated") else "e"
    x = _cut(bits) if t.startswith("bf16") else _middle(bits)
    return f"select '{t}' as type, {bits} as bits, {dims} as dims, q.vec_id as qid, p.vec_id as key, round(coalesce(list_cosine_distance(p.v, q.v), 2e0), 9) as d from (select vec_id, list_transform({base}[1:{dims}], lambda x: {x}) as v from rot) p, (select vec_id, {base}[1:{dims}] as v from rot where {ASKED}) q where p.vec_id <> q.vec_id"


_RECALLS = f"{_ROT}, {_PAIRED}, cells as ({' union all '.join(_cell_sql(*c) for c in CELLS)}), placed as (select *, row_number() over (partition by type, bits, dims, qid order by case when isnan(d) then 2e0 else d end, key) as c from cells), per as (select type, bits, dims, qid, count_if(c <= 10 and t <= 10) / 10e0 as a, count_if(c <= 100 and t <= 100) * 1e0 / count_if(t <= 100) as b, count_if(c <= 100 and t <= 10) / 10e0 as h from placed join truth using (qid, key) group by type, bits, dims, qid), recalls as (select type, bits, dims, cast(bits * dims // 8 as integer) as bytes, round(avg(a), 4) as recall10, round(avg(b), 4) as recall100, round(avg(h), 4) as recall10in100 from per group by type, bits, dims)"


def _truncated(t: str, bits: int, v):
    if t.startswith("bf16"):
        return quant.bf16_cut(v, bits)
    return vec.from_int8(vec.to_int8(v, 8.0), bits)


def recalls(spark, d) -> DataFrame:
    """Recall at 10, at 100, and of the ten nearest among a hundred, of vectors cut to so many bits and coordinates.

    Every pair of a query and a vector is met once and scored for all cells of the grid.
    """

    views = list(dict.fromkeys(c[:2] for c in CELLS))

    def both(df: DataFrame, key: str, v: str) -> DataFrame:
        return df.select(key, vec.doubles(F.col(v)).alias("e"), vec.hadamard_rotate(F.col(v), DIM).alias("r"))

    cuts = both(_pool(spark, d), "key", "vec").select("key", *[_truncated(t, b, F.col("r" if t.endswith("rotated") else "e")).alias(f"{t}{b}") for t, b in views])

    def score(p: blocks.Block, q: blocks.Block) -> list[np.ndarray]:
        return [np.nan_to_num(blocks.cosine_distances(p, q, views.index((t, b)), int(t.endswith("rotated")), n, 9, fast=True), nan=2.0) for t, b, n in CELLS]

    found = search.top_k(blocks.nearest(cuts, both(_asked(spark, d), "qid", "ref"), score, 100), 100, by=("cell", "qid")).withColumnRenamed("rank", "c")
    truth = search.exact(_pool(spark, d), _asked(spark, d), 100).select("qid", "key", F.col("rank").alias("t"))
    sizes = truth.groupBy("qid").agg(F.count("*").alias("size"))
    met = found.join(truth, ["qid", "key"], "left").join(sizes, "qid")
    hit = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("double"))
    per = met.groupBy("cell", "qid").agg((hit((F.col("c") <= 10) & (F.col("t") <= 10)) / 10).alias("a"), (hit(F.col("t") <= 100) / F.first("size")).alias("b"), (hit(F.col("t") <= 10) / 10).alias("h"))
    means = per.groupBy("cell").agg(F.round(F.avg("a"), 4).alias("recall10"), F.round(F.avg("b"), 4).alias("recall100"), F.round(F.avg("h"), 4).alias("recall10in100"))
    names = spark.createDataFrame([(i, t, b, n, b * n // 8) for i, (t, b, n) in enumerate(CELLS)], "cell int, type string, bits int, dims int, bytes int")
    return means.join(F.broadcast(names), "cell").drop("cell")


@_df("rp02_recall_grid", f"with {_RECALLS} select * from recalls")
def _(spark, d):
    return recalls(spark, d)


@_df("se03_truncated_grid", f"with {_RECALLS} select type, bits, dims, bytes, recall100, recall100 >= coalesce(max(recall100) over (order by bytes range between unbounded preceding and 1 preceding), -1) as frontier from recalls")
def _(spark, d):
    return search.pareto(recalls(spark, d).select("type", "bits", "dims", "bytes", "recall100"), "bytes", "recall100")


def _by_bits(scored: DataFrame, bits: tuple[int, ...]) -> DataFrame:
    return scored.select(F.get(F.lit(list(bits)), F.col("cell")).alias("bits"), "qid", "key", "dist")


@_df("ve08_int8_distance", " union all ".join(f"select {b} as bits, q.vec_id as qid, p.vec_id as key, round(list_cosine_distance(p.v, q.v), 6) as dist from (select vec_id, list_transform(cast(embedding[1:48] as double[]), lambda x: {_middle(b)}) as v from embeddings) p, (select vec_id, cast(embedding[1:48] as double[]) as v from embeddings where {ASKED}) q where p.vec_id <> q.vec_id" for b in (1, 4, 8)))
def _(spark, d):
    """Distances of whole queries from int8 codes cut to their upper bits, on the first 48 coordinates."""
    codes_, bits = vec.to_int8(F.col("vec"), 8.0), (1, 4, 8)
    pool = _pool(spark, d).select("key", *[F.slice(vec.from_int8(codes_, b), 1, 48).alias(f"b{b}") for b in bits])
    asked = _asked(spark, d).withColumn("ref", F.slice("ref", 1, 48))
    return _by_bits(blocks.pairs(pool, asked, lambda p, q: [blocks.cosine_distances(p, q, i, 0, digits=6, fast=True) for i in range(len(bits))]), bits)


@_df("ve09_masked_codes", "with " + ", ".join(f"m{b} as (select vec_id, list_transform(cast(embedding as double[]), lambda x: cast({_masked(b)} as double)) as v from embeddings)" for b in (2, 5)) + " " + " union all ".join(f"select {b} as bits, q.vec_id as qid, p.vec_id as key, round(list_cosine_distance(p.v, q.v), 6) as dist from m{b} p, m{b} q where {ASKED.replace('vec_id', 'q.vec_id')} and p.vec_id <> q.vec_id" for b in (2, 5)))
def _(spark, d):
    """Distances with both sides as int8 codes under the same mask."""
    bits = (2, 5)
    cut = lambda df, key, c: df.select(key, *[vec.mask_int8(vec.to_int8(F.col(c), 8.0), b).alias(f"b{b}") for b in bits])
    return _by_bits(blocks.pairs(cut(_pool(spark, d), "key", "vec"), cut(_asked(spark, d), "qid", "ref"), lambda p, q: [blocks.cosine_distances(p, q, i, i, digits=6) for i in range(len(bits))]), bits)


# Agreement of two representations: whole vectors and their first half
_HALVES = f"{_PAIRED}, halves as (select q.vec_id as qid, p.vec_id as key, list_cosine_distance(cast(p.embedding[1:32] as double[]), cast(q.embedding[1:32] as double[])) as half from embeddings p, embeddings q where {ASKED.replace('vec_id', 'q.vec_id')} and p.vec_id <> q.vec_id), both_ as (select qid, key, t, row_number() over (partition by qid order by half, key) as h, dist, half from truth join halves using (qid, key))"


def halves(p: blocks.Block, q: blocks.Block) -> list[np.ndarray]:
    """Distances of whole vectors and of their first half."""
    return [blocks.cosine_distances(p, q), blocks.cosine_distances(p, q, dims=32)]


def _halved(spark, d):
    half = lambda df, c: df.withColumn(c, F.slice(c, 1, 32))
    return (_pool(spark, d), _asked(spark, d)), (half(_pool(spark, d), "vec"), half(_asked(spark, d), "ref"))


@_df("se10_knn_overlap", f"with {_HALVES} select k, round(avg(o), 6) as overlap, round(avg(case when k = 1 then o end), 6) as nearest_match from (select k, qid, count_if(t <= k and h <= k) * 1e0 / k as o from both_ cross join (values (1), (5), (10), (20), (50)) k(k) group by k, qid) x group by k")
def _(spark, d):
    """The share of the k nearest that two representations have in common, and how often the nearest is the same."""
    near = blocks.nearest(_pool(spark, d), _asked(spark, d), halves, 50)
    place = lambda cell: F.max(F.when(F.col("cell") == cell, F.col("rank")))
    both = search.top_k(near, 50, by=("cell", "qid")).groupBy("qid", "key").agg(place(0).alias("t"), place(1).alias("h"))
    sizes = spark.createDataFrame([(k,) for k in (1, 5, 10, 20, 50)], "k int")
    common = both.where("t is not null and h is not null").select("qid", F.greatest("t", "h").alias("at"))
    per = _asked(spark, d).select("qid").crossJoin(F.broadcast(sizes)).join(common, "qid", "left").groupBy("k", "qid").agg((F.sum(F.coalesce(F.col("at") <= F.col("k"), F.lit(False)).cast("int")) / F.col("k")).alias("o"))
    return per.groupBy("k").agg(F.round(F.avg("o"), 6).alias("overlap"), F.round(F.avg(F.when(F.col("k") == 1, F.col("o"))), 6).alias("nearest_match"))


@_df("rp12_rank_correlation", f"with v as (select vec_id, cast(embedding as double[]) as e from embeddings where {ASKED} order by HASH[vec_id], vec_id limit 1000), p as (select list_cosine_distance(a.e, b.e) as x, list_cosine_distance(a.e[1:32], b.e[1:32]) as y from v a, v b where a.vec_id < b.vec_id), r as (select rank() over (order by round(x, 12)) + (count(*) over (partition by round(x, 12)) - 1) / 2e0 as rx, rank() over (order by round(y, 12)) + (count(*) over (partition by round(y, 12)) - 1) / 2e0 as ry from p) select round(corr(rx, ry), 6) as rsa, count(*) as pairs from r")
def _(spark, d):
    """Spearman correlation of the upper triangles of two distance matrices, of a thousand of the queries at most, in the order of a hash."""
    whole, half = _halved(spark, d)
    some = lambda asked: asked.orderBy(vec.hash_int(F.col("qid")), "qid").limit(1000)
    whole, half = (whole[0], some(whole[1])), (half[0], some(half[1]))
    among = lambda asked: search.distances(asked.select(F.col("qid").alias("key"), F.col("ref").alias("vec")), asked).where("qid < key")
    pairs = among(whole[1]).join(among(half[1]).withColumnRenamed("dist", "half"), ["qid", "key"]).select(F.round("dist", 12).alias("x"), F.round("half", 12).alias("y"))
    ranked = ranks.average_ranks(ranks.average_ranks(pairs, "x", "rx"), "y", "ry")
    return ranked.agg(F.round(F.corr("rx", "ry"), 6).alias("rsa"), F.count("*").alias("pairs"))


_LEVELS = {b: quant.gaussian_codebook(b)[1] for b in (8, 4, 2, 1)}


def _fidelity_sql(bits: int, use: str) -> str:
    levels = _LEVELS[bits]
    values = {"decoded": levels, "fixed": [float(round(x * 127 / max(map(abs, levels)))) for x in levels], "index": [i - (len(levels) - 1) / 2 for i in range(len(levels))]}[use]
    coded = f"list_transform(cast(embedding as double[]), lambda x: cast({values} as double[])[1 + len(list_filter(cast({quant.gaussian_codebook(bits)[0]} as double[]), lambda t: t <= x * 8))])"
    return f"select {bits} as bits, '{use}' as used, q.vec_id as qid, p.vec_id as key, round(list_cosine_distance(p.v, q.v), 9) as d from (select vec_id, {coded} as v from embeddings) p, (select vec_id, {coded} as v from embeddings where {ASKED}) q where p.vec_id <> q.vec_id"


@_df("rp16_code_fidelity", f"with {_PAIRED}, uses as ({' union all '.join(_fidelity_sql(b, u) for b in _LEVELS for u in ('decoded', 'fixed', 'index'))}), placed as (select *, row_number() over (partition by bits, used, qid order by d, key) as c from uses), per as (select bits, used, qid, count_if(c <= 10 and t <= 10) / 10e0 as r from placed join truth using (qid, key) group by bits, used, qid), p as (select bits, used, corr(1 - d, 1 - dist) as pearson from uses join pairs using (qid, key) group by bits, used) select bits, used, round(avg(r), 6) as recall, round(any_value(pearson), 6) as pearson from per join p using (bits, used) group by bits, used")
def _(spark, d):
    """Recall at 10 and correlation with the true cosines of codes on both sides: decoded, as fixed-point levels, as raw numbers. Every pair of a
    query and a vector is met once and scored for all settings."""
    settings = []
    for bits, levels in _LEVELS.items():
        fixed = [float(round(x * 127 / max(map(abs, levels)))) for x in levels]
        settings += [(bits, "decoded", levels), (bits, "fixed", fixed), (bits, "index", [i - (len(levels) - 1) / 2 for i in range(len(levels))])]

    def sides(df: DataFrame, key: str, v: str) -> DataFrame:
        coded = df.select(key, v, *[quant.encode(F.col(v), b, 8.0).alias(f"c{b}") for b in _LEVELS])
        level = lambda values: lambda c: F.get(F.lit(values), c)
        return coded.select(key, v, *[F.transform(f"c{b}", level(values)).alias(f"{used}{b}") for b, used, values in settings])

    def score(p: blocks.Block, q: blocks.Block) -> list[np.ndarray]:
        return [*[blocks.cosine_distances(p, q, i + 1, i + 1, digits=9, fast=True) for i in range(len(settings))], blocks.cosine_distances(p, q)]

    def moments(p: blocks.Block, q: blocks.Block, scores: list[np.ndarray]) -> np.ndarray:
        """Pairs, and sums, squares and products of the cosines of each setting and of the true ones."""
        y, sums = 1 - scores[-1], []
        for s in scores[:-1]:
            live = (q.keys[:, None] != p.keys[None, :]) & ~np.isnan(s) & ~np.isnan(y)
            a, b = 1 - s[live], y[live]
            sums.append([len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b])
        return np.array(sums)

    path = scratch(spark, "fidelity")
    blocks.nearest(sides(_pool(spark, d), "key", "vec"), sides(_asked(spark, d), "qid", "ref"), score, 10, tally=moments).write.parquet(path)
    met = spark.read.parquet(path)
    recall = search.cell_recall(met, len(settings), 10)
    n, a, b, aa, bb, ab = (F.col(f"s{i}") for i in range(6))
    pearson = blocks.tallied(met).select("cell", F.round((ab - a * b / n) / F.nullif(F.sqrt((aa - a * a / n) * (bb - b * b / n)), F.lit(0.0)), 6).alias("pearson"))
    names = spark.createDataFrame([(i, b, used) for i, (b, used, _) in enumerate(settings)], "cell int, bits int, used string")
    return F.broadcast(names).join(recall, "cell").join(pearson, "cell").drop("cell")


_VIEWS = {"whole": "e", "half": "e[1:32]", "signs": "list_transform(e, lambda x: case when x < 0 then -1e0 else 1e0 end)", "short": f"list_transform(e, lambda x: {_cut(9)})"}


@_df("rp13_overlap_matrix", "with v as (select vec_id, cast(embedding as double[]) as e from embeddings), views as (" + " union all ".join(f"select '{n}' as view, vec_id, {x} as v from v" for n, x in _VIEWS.items()) + f"), d as (select p.view, q.vec_id as qid, p.vec_id as key, round(list_cosine_distance(p.v, q.v), 9) as d from views p join views q on p.view = q.view where {ASKED.replace('vec_id', 'q.vec_id')} and p.vec_id <> q.vec_id), r as (select view, qid, key from (select *, row_number() over (partition by view, qid order by d, key) as rk from d) x where rk <= 10) select a.view, b.view as other, round(count(*) * 1e0 / (10 * (select count(*) from embeddings where {ASKED})), 6) as overlap from r a join r b using (qid, key) where a.view < b.view group by a.view, b.view")
def _(spark, d):
    """The overlap at 10 of each two of four representations."""
    asked = _asked(spark, d)
    views = {"whole": vec.doubles, "half": lambda v: F.slice(v, 1, 32), "signs": lambda v: F.transform(v, lambda x: F.when(x < 0, -1.0).otherwise(1.0)), "short": lambda v: quant.bf16_cut(v, 9)}
    sides = lambda df, key, c: df.select(key, *[f(F.col(c)).alias(n) for n, f in views.items()])
    near = blocks.nearest(sides(_pool(spark, d), "key", "vec"), sides(asked, "qid", "ref"), lambda p, q: [blocks.cosine_distances(p, q, i, i, digits=9) for i in range(len(views))], 10)
    found = search.top_k(near, 10, by=("cell", "qid")).select("qid", "key", F.get(F.lit(list(views)), F.col("cell")).alias("view"))
    most = asked.agg((F.count("*") * 10).alias("most"))
    each = found.groupBy("qid", "key").agg(F.collect_list("view").alias("views"))  # at most one for each view
    both = each.select(F.explode("views").alias("view"), "views").select("view", F.explode("views").alias("other")).where("view < other").groupBy("view", "other").agg(F.count("*").alias("n"))
    return both.crossJoin(F.broadcast(most)).select("view", "other", F.round(F.col("n") / F.col("most"), 6).alias("overlap"))


_RATES = [(b, n) for b in (1, 2, 4, 8) for n in (16, 32, 64)]


def _rate_sql(bits: int, dims: int) -> str:
    coded = f"list_transform(e[1:{dims}], lambda x: cast({_LEVELS[bits] if bits in _LEVELS else quant.gaussian_codebook(bits)[1]} as double[])[1 + len(list_filter(cast({quant.gaussian_codebook(bits)[0]} as double[]), lambda t: t <= x * 8))])"
    return f"select {bits} as bits, {dims} as dims, q.vec_id as qid, p.vec_id as key, round(list_cosine_distance(p.v, q.v), 9) as d from (select vec_id, {coded} as v from v) p, (select vec_id, e[1:{dims}] as v from v where {ASKED}) q where p.vec_id <> q.vec_id"


# Reports around one query
_ONE = "v as (select vec_id, cast(embedding as double[]) as e from embeddings), q as (select e as r from v where vec_id = 0)"


@_df("se06_filtered", f"with {_ONE}, d as (" + " union all ".join(f"select {b} as bits, vec_id as key, round(list_cosine_distance(list_transform(e, lambda x: {_cut(b)}), r), 9) as d from v cross join q where vec_id <> 0" for b in (16, 8, 4, 2, 1)) + "), s as (select bits, key, d, row_number() over (partition by bits order by case when isnan(d) or d is null then 2e0 else d end, key) as rank from d join documents on doc_id = key where text not ilike '%idiot%') select bits, key, cast(rank as integer) as rank from s where rank <= 5")
def _(spark, d):
    """The nearest of the vectors whose text passes a filter, by the bits that vectors are cut to; the filter comes first."""
    fine = _table(spark, d, "documents").where("text not ilike '%idiot%'").select(F.col("doc_id").alias("key"))
    pool = _pool(spark, d).join(fine, "key", "left_semi")
    one = _pool(spark, d).where("key = 0").select(F.col("key").alias("qid"), F.col("vec").alias("ref"))
    runs = [search.truncated(pool, one, 5, vec.to_bf16(F.col("vec"), b), DIM, 9).select(F.lit(b).alias("bits"), "key", "rank") for b in (16, 8, 4, 2, 1)]
    return reduce(lambda a, b: a.unionByName(b), runs)


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))"


@_df("se09_contrasting_tokens", f"with {_ONE}, near as (select vec_id from v cross join q where vec_id <> 0 order by list_cosine_distance(e, r), vec_id limit 100), w as (select doc_id, unnest({_WORDS}) as token, doc_id in (select vec_id from near) as hit from documents), n as (select count(*) as docs, count_if(doc_id in (select vec_id from near)) as hits from documents) select token, cast(count_if(hit) as bigint) as n, round((count_if(hit) * 1e0 / any_value(hits)) / (count(*) * 1e0 / any_value(docs)), 6) as lift from w cross join n group by token having count_if(hit) >= 3 and count(*) >= 10")
def _(spark, d):
    """Tokens of the hundred nearest documents: how much more often they occur there than in all."""
    from lumenvec.functions import text as tx

    one = _pool(spark, d).where("key = 0").select(F.col("key").alias("qid"), F.col("vec").alias("ref"))
    near = search.exact(_pool(spark, d), one, 100).select(F.col("key").alias("doc_id"), F.lit(True).alias("hit"))
    docs = _table(spark, d, "documents").join(F.broadcast(near), "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    n = docs.agg(F.count("*").alias("docs"), F.sum(F.col("hit").cast("long")).alias("hits"))
    words = docs.select("hit", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.sum(F.col("hit").cast("long")).alias("n"), F.count("*").alias("all"))
    return words.where("n >= 3 and all >= 10").crossJoin(F.broadcast(n)).select("token", "n", F.round((F.col("n") / F.col("hits")) / (F.col("all") / F.col("docs")), 6).alias("lift"))

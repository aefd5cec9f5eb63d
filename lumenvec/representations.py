"""Queries that compare representations: quantizers with and without rotation, rate grids with triplets, guards, carried positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lumenvec.catalogue import ASKED, ORACLE_SQL, QUERIES, _asked, _df, _pool, _table
from lumenvec.evaluation import _HALVES, _PAIRED, _RATES, _ROT, DIM, _rate_sql, code_distances, coded, codes, halves
from lumenvec.exchange import scratch
from lumenvec.functions import quant, vec
from lumenvec.operators import blocks, gram, ranks, rotation, search

# Scalar quantizers with a scale for each coordinate
_TOP = "l as (select vec_id, i, cast(embedding[i] as double) as x from embeddings cross join (select unnest(range(1, 65)) as i) s), m as (select i, max(abs(x)) as top from l group by i)"


def _tops(spark, d) -> Column:
    """The largest absolute value of each coordinate, as a literal: a number for each of them goes to the driver."""
    rows = _table(spark, d, "embeddings").select(F.posexplode(vec.doubles(F.col("embedding"))).alias("i", "x")).groupBy("i").agg(F.max(F.abs("x")).alias("top")).orderBy("i").collect()
    return F.lit([float(r["top"]) for r in rows])


@_df("ve17_absmax_codes", f"with {_TOP} select l.vec_id, cast(sum(round(x / top * 127)) as bigint) as int8, cast(sum(round(x / top * 7)) as bigint) as int4, cast(sum(round(x / top)) as bigint) as int2, cast(count_if(x >= 0) as bigint) as signs from l join m on l.i = m.i where top > 0 group by l.vec_id")
def _(spark, d):
    """Codes of 8, 4 and 2 bits on the scale of each coordinate, and signs; their sums."""
    scaled = _table(spark, d, "embeddings").select("vec_id", F.zip_with(vec.doubles(F.col("embedding")), _tops(spark, d), lambda x, t: F.when(t > 0, x / t)).alias("v"))
    codes_ = lambda most: F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.round(x * most).cast("long"), F.lit(0))).alias(f"int{most.bit_length() + 1}")
    return scaled.select("vec_id", codes_(127), codes_(7), codes_(1), F.size(F.filter("v", lambda x: x >= 0)).cast("long").alias("signs"))


_E4M3, _E5M2 = (3, -6, 448.0), (2, -14, 57344.0)


def _float8_sql(mantissa: int, least: int, most: float) -> str:
    y = f"(x / top * {most}e0)"
    step = f"pow(2e0, greatest(floor(log2(abs({y}))), {least}) - {mantissa})"
    return f"sum(case when x = 0 then 0e0 else sign(x) * least({most}e0, ceil(abs({y}) / {step} - 0.5) * {step}) * top / {most}e0 end)"


@_df("ve18_scaled_float8", f"with {_TOP} select l.vec_id, round({_float8_sql(*_E4M3)}, 6) as e4m3, round({_float8_sql(*_E5M2)}, 6) as e5m2 from l join m on l.i = m.i where top > 0 group by l.vec_id")
def _(spark, d):
    """Small floats of two kinds on the scale of each coordinate, decoded; their sums."""
    rows = _table(spark, d, "embeddings").select("vec_id", F.arrays_zip(vec.doubles(F.col("embedding")).alias("x"), _tops(spark, d).alias("t")).alias("v"))
    back = lambda kind: F.round(vec.total(F.transform("v", lambda c: F.when(c["t"] > 0, quant.float8(c["x"] / c["t"] * kind[2], *kind) * c["t"] / kind[2]).otherwise(0.0))), 6)
    return rows.select("vec_id", back(_E4M3).alias("e4m3"), back(_E5M2).alias("e5m2"))


_CELLS = (8, 7, 6, 5, 4, 2)


@_df("ve19_quantile_grid", f"with {_TOP} " + " union all ".join(f"select {b} as bits, i, code, round(avg(x), 6) as level, count(*) as n from (select i, ntile({1 << b}) over (partition by i order by x, vec_id) as code, x from l) t group by i, code" for b in _CELLS))
def _(spark, d):
    """Codebooks of equal counts, of 8 to 2 bits a coordinate, from one numbering of all values in ranges."""
    x = _table(spark, d, "embeddings").select("vec_id", F.posexplode(vec.doubles(F.col("embedding"))).alias("p", "x")).select("vec_id", (F.col("p") + 1).cast("long").alias("i"), "x")
    numbered = ranks.row_numbers(x, ["i", "x", "vec_id"])
    firsts = numbered.groupBy("i").agg(F.min("rn").alias("first"), F.count("*").alias("n"))
    at = numbered.join(F.broadcast(firsts), "i").select("i", "x", "n", (F.col("rn") - F.col("first")).alias("at"), F.explode(F.array(*[F.lit(b) for b in _CELLS])).alias("bits"))  # a row per coordinate
    at = at.withColumn("cells", F.expr("shiftleft(1L, bits)")).withColumn("wide", F.expr("n % cells * (n div cells + 1)"))  # rows in the first cells, which have one more
    code = F.expr("case when at < wide then at div (n div cells + 1) else n % cells + (at - wide) div greatest(n div cells, 1) end + 1")
    return at.groupBy("bits", "i", code.alias("code")).agg(F.round(F.avg("x"), 6).alias("level"), F.count("*").alias("n"))


def _levels_sql(bits: int) -> str:
    cuts, levels = quant.gaussian_codebook(bits)
    return f"list_transform(e, lambda x: cast({levels} as double[])[1 + len(list_filter(cast({cuts} as double[]), lambda t: t <= x * 8))] / 8)"


@_df("ve21_sphere", "with v as (select vec_id, cast(embedding as double[]) as e from embeddings) " + " union all ".join(f"select vec_id, {b} as bits, round(list_inner_product(e, b) / sqrt(list_inner_product(e, e) * list_inner_product(b, b)), 6) as cosine from (select vec_id, e, {_levels_sql(b)} as b from v) t" for b in (1, 2, 4)))
def _(spark, d):
    """Levels that know only the dimension: coordinates of unit vectors as if normal with a deviation of one over its root. Cosines to what is decoded."""
    e = _table(spark, d, "embeddings").select("vec_id", vec.doubles(F.col("embedding")).alias("e"))
    scale = float(DIM) ** 0.5
    back = F.array(*[F.struct(F.lit(b).alias("bits"), quant.decode(quant.encode(F.col("e"), b, scale), b, scale).alias("b")) for b in (1, 2, 4)])
    each = e.select("vec_id", "e", F.explode(back).alias("r"))
    return each.select("vec_id", "r.bits", F.round(1 - vec.cosine_distance(F.col("e"), F.col("r.b")), 6).alias("cosine"))


@_df("ve20_rotated_codes", f"with {_ROT} select round(avg(list_inner_product(r, b) / sqrt(list_inner_product(r, r) * list_inner_product(b, b))), 6) as cosine from (select r, {_levels_sql(2).replace('list_transform(e,', 'list_transform(r,')} as b from rot) t")
def _(spark, d):
    """Two bits a coordinate after rotation, on a scale that depends on the dimension alone: mean cosine of the decoded vectors."""
    e = _table(spark, d, "embeddings").select(vec.hadamard_rotate(F.col("embedding"), 64).alias("r"))
    back = e.select("r", quant.decode(quant.encode(F.col("r"), 2, 8.0), 2, 8.0).alias("b"))
    return back.agg(F.round(1 - F.avg(vec.cosine_distance(F.col("r"), F.col("b"))), 6).alias("cosine"))


def _fitted(df: DataFrame, bits: int, column: str = "vec") -> Column:
    """Levels on the deviation of each coordinate, which the driver gets as a number for each."""
    rows = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.stddev_pop("x").alias("s")).orderBy("i").collect()
    scale = F.lit([1.0 / max(float(r["s"]), 1e-12) for r in rows])
    unit = F.zip_with(column, scale, lambda x, s: x * s)
    return F.zip_with(quant.decode(quant.encode(unit, bits, 1.0), bits, 1.0), scale, lambda x, s: x / s)


def agreement(met: DataFrame, by: list[str], dist: str = "dist", truth: str = "truth") -> DataFrame:
    """(by..., triplets): how often two rows of neighbouring keys (2k and 2k + 1) are in the same order around a query by both distances."""
    side = lambda c, k: F.max(F.when(F.pmod("key", F.lit(2)) == k, F.col(c))).alias(f"{c}{k}")
    pair = met.groupBy(*by, "qid", F.floor(F.col("key") / 2).alias("pair")).agg(F.count("*").alias("n"), *[side(c, k) for c in (dist, truth) for k in (0, 1)]).where("n = 2")
    return pair.groupBy(*by).agg(F.round(F.avg(((F.col(f"{dist}0") < F.col(f"{dist}1")) == (F.col(f"{truth}0") < F.col(f"{truth}1"))).cast("double")), 6).alias("triplets"))


def _agreeing(p: blocks.Block, q: blocks.Block, scores: list[np.ndarray]) -> np.ndarray:
    """``agreement`` of two blocks, of each cell with the last one: pairs in the same order, and pairs."""
    pair = p.keys // 2
    n = np.bincount(np.unique(pair, return_inverse=True)[1])
    first = np.flatnonzero(np.repeat(n == 2, n) & np.append(pair[1:] == pair[:-1], False) & (p.keys % 2 == 0))
    first = first[p.keys[first] != p.keys[np.minimum(first + 1, len(pair) - 1)]]
    truth = scores[-1]
    live = (pair[first][None, :] != q.keys[:, None] // 2) & ~np.isnan(truth[:, first] + truth[:, first + 1])
    rising = [s[:, first] < s[:, first + 1] for s in scores]
    return np.array([[((r == rising[-1]) & live).sum(), live.sum()] for r in rising[:-1]])


def spearman(met: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, rsa): rank correlation of two columns within each group, ties sharing their mean rank; ranks are made in ranges of the whole table."""
    for c in (a, b):
        numbered = ranks.row_numbers(met, [by, c, "qid", "key"], name="__n")
        shared = numbered.groupBy(by, c).agg(F.avg("__n").alias(f"__r_{c}"))
        met = numbered.drop("__n").join(shared, [by, c])
    return met.groupBy(by).agg(F.round(F.corr(f"__r_{a}", f"__r_{b}"), 6).alias("rsa"))


@_df("ve20_rotation_ablation")
def _(spark, d):
    """Codes of 1, 2 and 4 bits, with and without a random rotation, on the scale of the dimension or of each coordinate: recall at 10, rank
    correlation of distances, CKA with the original and agreement of triplets, queries exact and rows decoded."""
    pool, asked = _pool(spark, d).withColumn("vec", vec.doubles(F.col("vec"))), _asked(spark, d).withColumn("ref", vec.doubles(F.col("ref")))
    turn = rotation.haar(DIM)
    path, cells, fixed = scratch(spark, "rotation"), [], float(DIM) ** 0.5
    rotation.rotate(pool.withColumn("turned", F.col("vec")), "turned", turn).write.parquet(f"{path}/base")
    base = spark.read.parquet(f"{path}/base")
    for rotated in (False, True):
        v = "turned" if rotated else "vec"
        for bits in (1, 2, 4):
            for scale, back in (("sphere", quant.decode(quant.encode(F.col(v), bits, fixed), bits, fixed)), ("fitted", _fitted(base, bits, v))):
                cells.append(((rotated, scale, bits), v, back.alias(f"c{len(cells)}")))
    base.select("key", "vec", "turned", *[c[2] for c in cells]).write.parquet(f"{path}/coded")
    coded = spark.read.parquet(f"{path}/coded")
    pool = coded.select("key", "vec", *[f"c{i}" for i in range(len(cells))])
    both = rotation.rotate(asked.withColumn("turned", F.col("ref")), "turned", turn)

    turns = [int(c[0][0]) for c in cells]

    def score(p: blocks.Block, q: blocks.Block) -> list[np.ndarray]:
        return [*[blocks.cosine_distances(p, q, 1 + i, t, digits=9, fast=True) for i, t in enumerate(turns)], blocks.cosine_distances(p, q, digits=12)]

    blocks.nearest(pool, both, score, 10, tally=_agreeing, together=2).write.parquet(f"{path}/near")
    met = spark.read.parquet(f"{path}/near")
    triplets = blocks.tallied(met).select("cell", F.round(F.col("s0") / F.nullif(F.col("s1"), F.lit(0.0)), 6).alias("triplets"))
    rsa = ranks.block_correlations(pool, both, score, [9] * len(cells) + [12]).select("cell", F.round("c", 6).alias("rsa"))
    each = coded.select(F.explode(F.array(*[F.struct(F.lit(i).alias("cell"), F.col(c[1]).alias("x"), F.col(f"c{i}").alias("vec")) for i, c in enumerate(cells)])).alias("r")).select("r.*")  # a row per cell
    cka = gram.grouped_cka(each, "cell", F.col("x"), F.col("vec"))
    names = F.broadcast(spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cells)], "cell int, rotated boolean, scale string, bits int"))
    out = names.join(search.cell_recall(met, len(cells), 10), "cell").join(rsa, "cell").join(cka.select("cell", F.round("cka", 6).alias("cka")), "cell").join(triplets, "cell")
    return out.drop("cell")


_TRIPLES = "trip as (select bits, dims, round(avg(case when (d0 < d1) = (t0 < t1) then 1e0 else 0e0 end), 6) as triplets from (select bits, dims, qid, key // 2 as pair, max(case when key % 2 = 0 then d end) as d0, max(case when key % 2 = 1 then d end) as d1, max(case when key % 2 = 0 then round(dist, 12) end) as t0, max(case when key % 2 = 1 then round(dist, 12) end) as t1 from cells join truth using (qid, key) group by 1, 2, 3, 4 having count(*) = 2) t group by bits, dims)"


_RATE_SQL = f"with v as (select vec_id, cast(embedding as double[]) as e from embeddings), {_PAIRED}, cells as ({' union all '.join(_rate_sql(*c) for c in _RATES)}), placed as (select *, row_number() over (partition by bits, dims, qid order by d, key) as c from cells), per as (select bits, dims, qid, count_if(c <= 10 and t <= 10) / 10e0 as r from placed join truth using (qid, key) group by bits, dims, qid), g as (select bits, dims, round(avg(r), 6) as recall, cast(bits * dims // 8 as integer) as bytes from per group by bits, dims) select *, recall >= coalesce(max(recall) over (order by bytes range between unbounded preceding and 1 preceding), -1) as frontier from g"


@_df("rp18_rate_grid", _RATE_SQL.replace(" select *, recall >=", f", {_TRIPLES} select g.*, triplets, recall >=").replace("as frontier from g", "as frontier from g join trip using (bits, dims)"))
def _(spark, d):
    """Recall at 10 and agreement of triplets over dimensions and bits of Gaussian codes, with the frontier of bytes; every pair is met once."""
    pool, asked = _pool(spark, d), _asked(spark, d)
    widths = list(dict.fromkeys(b for b, _ in _RATES))
    decoded = pool.select("key", "vec", *[quant.decode(quant.encode(F.col("vec"), b, 8.0), b, 8.0).alias(f"b{b}") for b in widths])

    def score(p: blocks.Block, q: blocks.Block) -> list[np.ndarray]:
        cells = [blocks.cosine_distances(p, q, 1 + widths.index(b), 0, n, 9, fast=True) for b, n in _RATES]
        return [*[np.nan_to_num(c, nan=2.0) for c in cells], blocks.cosine_distances(p, q, digits=12)]

    path = scratch(spark, "rates")
    blocks.nearest(decoded, asked, score, 10, tally=_agreeing, together=2).write.parquet(path)
    met = spark.read.parquet(path)
    recall = search.cell_recall(met, len(_RATES), 10)
    triplets = blocks.tallied(met).select("cell", F.round(F.col("s0") / F.nullif(F.col("s1"), F.lit(0.0)), 6).alias("triplets"))
    names = spark.createDataFrame([(i, b, n, b * n // 8) for i, (b, n) in enumerate(_RATES)], "cell int, bits int, dims int, bytes int")
    return search.pareto(F.broadcast(names).join(recall, "cell").join(triplets, "cell").drop("cell"), "bytes", "recall")


@_df("rp15_neighbour_order", f"with {_HALVES}, r as (select qid, rank() over (partition by qid order by round(dist, 12)) as a, rank() over (partition by qid order by round(half, 12)) as b from both_), s as (select qid, corr(a, b) as c from r group by qid) select round(avg(c), 6) as spearman, count(*) as queries from s")
def _(spark, d):
    """The mean rank correlation of the orders in which two representations put all vectors around a query. Up to ``ranks.HELD_PAIRS`` vectors
    pairs are ranked where they are scored; beyond, or where queries share an id, ranks are numbers in ranges of all pairs by query."""
    pool, asked = _pool(spark, d), _asked(spark, d)
    scores = lambda p, q: [blocks.rounded(x, 12) for x in halves(p, q)]
    rows = pool.count()
    if rows <= ranks.HELD_PAIRS and asked.groupBy("qid").count().where("count > 1").isEmpty():
        return ranks.query_correlations(pool, asked, scores, rows).agg(F.round(F.avg("c"), 6).alias("spearman"), F.count("*").alias("queries"))
    path = scratch(spark, "orders")
    blocks.beside(pool, asked, scores, ["a", "b"]).select("qid", "a", "b").write.parquet(f"{path}/pairs")
    ranks.rank_in_parts(spark.read.parquet(f"{path}/pairs"), "qid", "a").write.parquet(f"{path}/once")
    ranks.rank_in_parts(spark.read.parquet(f"{path}/once"), "qid", "b").write.parquet(f"{path}/twice")
    sums = ranks.part_moments(spark.read.parquet(f"{path}/twice"), "qid", "a", "b")
    return ranks.correlations(sums, "qid", "a", "b").agg(F.round(F.avg("c"), 6).alias("spearman"), F.count("*").alias("queries"))


@_df("tk10_rank_by_sort", "select o_orderkey, row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) - 1 as r from orders")
def _(spark, d):
    """Places within each status, from numbers of the whole table in ranges: three statuses aren't three tasks."""
    numbered = ranks.row_numbers(_table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey"), ["o_orderstatus", "o_totalprice", "o_orderkey"])
    firsts = numbered.groupBy(F.col("o_orderstatus").alias("s")).agg(F.min("rn").alias("first"))
    return numbered.join(firsts, F.col("o_orderstatus").eqNullSafe(F.col("s"))).select("o_orderkey", (F.col("rn") - F.col("first")).alias("r"))


def _coded_sql(bits: int) -> str:
    cuts, levels = quant.gaussian_codebook(bits)
    return f"select {bits} as bits, code, round(cast({levels} as double[])[code + 1], 9) as level, count(*) as n from (select cast(len(list_filter(cast({cuts} as double[]), lambda t: t <= x * 8)) as integer) as code from (select unnest(cast(embedding as double[])) as x from embeddings) u) t group by code"


@_df("ve14_codebook", " union all ".join(_coded_sql(b) for b in (1, 2, 4, 8)))
def _(spark, d):
    """The closed-form codebook of 256 levels and those of fewer bits that it contains: which levels the vectors' coordinates use, how often."""
    e = _table(spark, d, "embeddings").select(vec.doubles(F.col("embedding")).alias("e"))
    coded = e.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), quant.encode(F.col("e"), b, 8.0).alias("codes")) for b in (1, 2, 4, 8)])).alias("c")).select("c.bits", F.explode("c.codes").alias("code"))
    levels = F.create_map(*[x for b in (1, 2, 4, 8) for x in (F.lit(b), F.lit(quant.gaussian_codebook(b)[1]))])
    return coded.groupBy("bits", "code").agg(F.count("*").alias("n")).select("bits", "code", F.round(F.get(levels[F.col("bits")], F.col("code")), 9).alias("level"), "n")


#: Cells of the histogram of coordinates, and rounds of fitting.
HISTOGRAM, ROUNDS = 8192, 40


def lloyd_max(values: np.ndarray, counts: np.ndarray, bits: int, rounds: int = ROUNDS) -> np.ndarray:
    """Levels of least squared error for a weighted list of values in order: each the mean of the values that are nearest to it."""
    cells = 1 << bits
    upto = np.cumsum(counts)
    levels = values[np.searchsorted(upto, (np.arange(cells) + 0.5) / cells * upto[-1])].astype(float)
    for _ in range(rounds):
        cell = np.searchsorted((levels[1:] + levels[:-1]) / 2, values, side="right")
        n = np.bincount(cell, counts, cells)
        levels = np.where(n > 0, np.bincount(cell, counts * values, cells) / np.maximum(n, 1), levels)
    return levels


@_df("ve16_sampled_codebook")
def _(spark, d):
    """Levels of 1, 2, 3, 4 and 8 bits fitted to all coordinates by rounds of nearest levels and means, over a histogram of bounded size."""
    x = _table(spark, d, "embeddings").select(F.explode(vec.doubles(F.col("embedding"))).alias("x"))
    lo, hi = x.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return spark.createDataFrame([], "bits int, code int, level double")
    cell = F.floor((F.col("x") - lo) / max(hi - lo, 1e-300) * (HISTOGRAM - 1))
    held = x.groupBy(cell.alias("c")).agg(F.avg("x").alias("v"), F.count("*").alias("n")).orderBy("c").collect()  # at most HISTOGRAM rows
    values, counts = np.array([r["v"] for r in held]), np.array([r["n"] for r in held], float)
    return spark.createDataFrame([(b, i, float(v)) for b in (1, 2, 3, 4, 8) for i, v in enumerate(lloyd_max(values, counts, b))], "bits int, code int, level double")


# Reports over the rate grid
_GRID_SQL = ORACLE_SQL["rp18_rate_grid"]


@_df("rp06_value_per_byte", f"select bits, dims, recall, bytes, round(recall / bytes, 9) as worth from ({_GRID_SQL}) t where recall >= 0.5 order by recall / bytes desc, bytes, bits limit 1")
def _(spark, d):
    """The setting of the grid with the most recall a byte, of those with a recall of a half or more."""
    grid = QUERIES["rp18_rate_grid"](spark, d).where("recall >= 0.5").withColumn("w", F.col("recall") / F.col("bytes"))
    return grid.orderBy(F.desc("w"), "bytes", "bits").limit(1).select("bits", "dims", "recall", "bytes", F.round("w", 9).alias("worth"))


@_df("rp07_pivot", f"select bits, max(case when dims = 16 then recall end) as d16, max(case when dims = 32 then recall end) as d32, max(case when dims = 64 then recall end) as d64 from ({_GRID_SQL}) t group by bits")
def _(spark, d):
    """Recalls as a table of bits by dimensions."""
    return QUERIES["rp18_rate_grid"](spark, d).groupBy("bits").pivot("dims", [16, 32, 64]).agg(F.max("recall")).toDF("bits", "d16", "d32", "d64")


_PLACES = "case bits when 8 then 0 when 4 then 1 when 2 then 2 else 3 end"


@_df("rp08_merge_runs", f"with grid as ({_GRID_SQL}) select *, row_number() over (order by case sample when 'all' then 0 else 1 end, {_PLACES}, dims desc) as place from (select 'all' as sample, bits, dims, recall from grid where dims > 16 union all select 'small', bits, dims, recall from grid where bits < 8) t")
def _(spark, d):
    """Two runs of the grid merged: one that has no column for its sample gets the default, and rows are put in the order of samples, then of
    bits as listed, then of dimensions from the largest."""
    path = scratch(spark, "runs")
    QUERIES["rp18_rate_grid"](spark, d).write.parquet(f"{path}/grid")
    grid = spark.read.parquet(f"{path}/grid").select("bits", "dims", "recall")
    grid.where("dims > 16").write.parquet(f"{path}/first")
    grid.where("bits < 8").withColumn("sample", F.lit("small")).write.parquet(f"{path}/second")
    runs = spark.read.parquet(f"{path}/first").unionByName(spark.read.parquet(f"{path}/second"), allowMissingColumns=True).fillna("all", ["sample"])
    order = Window.orderBy(F.when(F.col("sample") == "all", 0).otherwise(1), F.expr(_PLACES), F.desc("dims"))  # a row per setting
    return runs.select("sample", "bits", "dims", "recall", F.row_number().over(order).alias("place"))


# Guards
class PathNotTaken(RuntimeError):
    """A two-stage search that didn't go by its codes."""


def guarded(pool: DataFrame, queries: DataFrame, k: int, multiplier: int, code, path: str, most: float = 1.4) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """A two-stage search with the rows that each stage scored: (result, [(stage, scored, pairs of queries and pool)]).

    Both stages are counted where their rows pass. The codes must have scored every pair, and both stages together at most ``most`` times
    as many: a search that scores whole vectors for all pairs instead reads twice the pool, and is an error, as is one whose codes are skipped.
    """
    spark = pool.sparkSession
    pairs = queries.count() * pool.count()
    own = pool.join(queries, pool["key"] == queries["qid"], "left_semi").count()
    first, second = Observation("codes"), Observation("vectors")
    scored = code(pool, queries).observe(first, F.count(F.lit(1)).alias("rows"))
    search.top_k(search.limited(scored, k * multiplier), k * multiplier).select("qid", "key").write.parquet(f"{path}/candidates")
    candidates = spark.read.parquet(f"{path}/candidates")
    search.rescore(candidates.observe(second, F.count(F.lit(1)).alias("rows")), pool, queries, k).select("qid", "key", "rank", "dist").write.parquet(f"{path}/found")
    rows = [("codes", first.get["rows"], pairs - own), ("vectors", second.get["rows"], pairs - own)]
    if rows[0][1] != pairs - own or rows[0][1] + rows[1][1] > most * (pairs - own) and pairs > 0:
        raise PathNotTaken(f"rows scored by stage, of {pairs - own} pairs: {rows}")
    return spark.read.parquet(f"{path}/found"), rows


_COUNTED = "select 'codes' as stage, (select count(*) from embeddings p, embeddings q where {0} and p.vec_id <> q.vec_id) as scored union all select 'vectors', (select sum(least(n, 50)) from (select q.vec_id, count(*) as n from embeddings p, embeddings q where {0} and p.vec_id <> q.vec_id group by q.vec_id) t)"


@_df("rp09_read_guard", _COUNTED.format("q." + ASKED).replace("(select sum", "(select cast(sum").replace("50)) from", "50)) as bigint) from"))
def _(spark, d):
    """Rows that each stage of a search by one-bit codes scored, checked to have gone by the codes."""
    _, rows = guarded(_pool(spark, d), _asked(spark, d), 10, 5, codes(1), scratch(spark, "guard"))
    return spark.createDataFrame([r[:2] for r in rows], "stage string, scored long")


@_df("rp04_exactness_control", "select 1e0 as recall, true as passes")
def _(spark, d):
    """All rows as candidates of the one-bit codes, rescored: what is found must be the truth that is made without codes, else an error."""
    pool, asked = _pool(spark, d), _asked(spark, d)
    found = search.every_candidate(*coded(pool, asked), lambda p, q: code_distances(p, q, 1), 10)
    truth = search.exact(pool, asked, 10)
    recall = search.recall(found, truth, 10)
    value = recall.first()[0]
    if value is not None and value < 1:
        raise PathNotTaken(f"recall of the exact second stage is {value}")
    return recall.select("recall", (F.col("recall") == 1).alias("passes"))


# Positions of a sample, carried to all rows
LANDMARKS, CARRIERS = 4096, 5
#: Rows that are compared with all of the sample at once, which bounds a task's memory.
CARRIED_ROWS = 256


def carry(rows: DataFrame, sample: list[tuple[int, np.ndarray, np.ndarray]], k: int = CARRIERS) -> DataFrame:
    """(key, x, y) of ``rows`` (key, vec): a sampled row has its own position, any other the mean of those of its ``k`` nearest sampled ones
    by cosine, weighted by one over the distance. ``sample`` is a bounded list of (key, vector, position)."""
    keys = np.array([s[0] for s in sample], np.int64)
    m = np.stack([s[1] for s in sample]) if sample else np.zeros((0, 1))
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    places = np.stack([s[2] for s in sample]) if sample else np.zeros((0, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CARRIED_ROWS):
                yield from carried(batch.slice(lo, CARRIED_ROWS))

    def carried(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
        dist = np.round(1 - (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)) @ unit.T, 9)
        n = min(k, len(keys))
        order = np.lexsort((np.broadcast_to(keys, dist.shape), dist), axis=1)[:, :n] if n else np.zeros((len(v), 0), int)
        weight = 1 / (np.take_along_axis(dist, order, 1) + 1e-6)
        out = (weight[:, :, None] * places[order]).sum(1) / np.maximum(weight.sum(1, keepdims=True), 1e-300)
        mine = {key: i for i, key in enumerate(keys.tolist())}
        ids = batch.column(0).to_pylist()
        for r, key in enumerate(ids):
            if key in mine:
                out[r] = places[mine[key]]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[:, 0]), pa.array(out[:, 1])], ["key", "x", "y"])

    return rows.select("key", vec.doubles(F.col("vec")).alias("vec")).where("vec is not null").mapInArrow(run, "key long, x double, y double")


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the rows by hash, at most ``LANDMARKS`` of them in its order."""
    e = _pool(spark, d).withColumn("h", vec.hash_int(F.col("key"))).where("h % 10 = 0 and vec is not null")
    return e.orderBy("h", "key").limit(LANDMARKS).select("key", vec.doubles(F.col("vec")).alias("vec"))


_LANDMARKS = f"v as (select vec_id, cast(embedding as double[]) as e, HASH[vec_id] as h from embeddings), s as (select vec_id as sid, e as se, list_sum(e[1:32]) as sx, list_sum(e[33:64]) as sy from v where h % 10 = 0 order by h, vec_id limit {LANDMARKS}), n as (select vec_id, sid, sx, sy, round(list_cosine_distance(e, se), 9) as dist, row_number() over (partition by vec_id order by round(list_cosine_distance(e, se), 9), sid) as rn from v, s), c as (select vec_id, sum(sx / (dist + 1e-6)) / sum(1 / (dist + 1e-6)) as x, sum(sy / (dist + 1e-6)) / sum(1 / (dist + 1e-6)) as y from n where rn <= {CARRIERS} group by vec_id)"


@_df("mp10_carried_positions", f"with {_LANDMARKS} select c.vec_id as key, round(coalesce(sx, x), 5) as x, round(coalesce(sy, y), 5) as y from c left join s on c.vec_id = sid")
def _(spark, d):
    """The map's positions of a sample carried to every row; none is left out."""
    sample = [(r["key"], np.array(r["vec"]), np.array([sum(r["vec"][:32]), sum(r["vec"][32:64])])) for r in sampled(spark, d).collect()]  # at most LANDMARKS rows
    return carry(_pool(spark, d), sample).select("key", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@_df("mp10_fitted_positions")
def _(spark, d):
    """The same with positions that are fitted to the sample: its two principal axes."""
    some = sampled(spark, d)
    axes = gram.principal_axes(some, F.col("vec"), 2)
    held = some.collect()  # at most LANDMARKS rows
    middle = np.mean([r["vec"] for r in held], 0) if held else 0.0
    return carry(_pool(spark, d), [(r["key"], np.array(r["vec"]), axes @ (np.array(r["vec"]) - middle)) for r in held])


# The corpus of record texts
_DECODED = "regexp_replace(regexp_replace(regexp_replace({0}, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_a}', '{_b}')"
_DECODED = r"trim(regexp_replace(" + _DECODED + r", '\s+', ' ', 'g'))"


@_df("tx01_corpus", f"with u as (select conv_id, turn, role, text, row_number() over (partition by conv_id, turn % 2 order by turn desc, role, text) as rn from conversations where role <> 'system'), t as (select conv_id, turn, {_DECODED.format("coalesce(role, '') || ' ' || coalesce(text, '') || ' &amp; <b>' || coalesce(role, '') || '</b>'")} as doc, text from u where rn = 1) select conv_id, turn, doc, HASH[conv_id] % 512 as shard from t where text is not null and text <> '' and doc <> ''")
def _(spark, d):
    """The latest version of each key (conversation and side) that isn't deleted (system rows stand for these), stripped of markup, decoded,
    trimmed; empty ones go; hashed into 512 shards. The texts have no markup, so some is added to both."""
    from lumenvec.functions import text as tx

    live = _table(spark, d, "conversations").where("role <> 'system'")
    newest = live.groupBy("conv_id", F.expr("turn % 2").alias("side")).agg(F.min(F.struct((-F.col("turn")).alias("t"), "role", "text")).alias("m"))
    raw = F.concat(F.coalesce("m.role", F.lit("")), F.lit(" "), F.coalesce("m.text", F.lit("")), F.lit(" &amp; <b>"), F.coalesce("m.role", F.lit("")), F.lit("</b>"))
    docs = newest.where("m.text is not null and m.text <> ''").select("conv_id", (-F.col("m.t")).alias("turn"), tx.html_to_text(raw).alias("doc"))
    return docs.where("doc <> ''").select("conv_id", "turn", "doc", (vec.hash_int(F.col("conv_id")) % 512).alias("shard"))

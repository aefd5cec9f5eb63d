"""More queries of the catalogue: quantizers, representation studies, search reports, colours, rasters and small scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenvec.catalogue import _PAIRS, _asked, _df, _pool, _sql, _table
from lumenvec.functions import colour, quant, vec
from lumenvec.operators import gram, images, ranks, search

# Order, joins, scalars
_sql("tk01_order", "select p_partkey, p_brand from part order by p_brand desc, p_partkey")
_sql("tk04_last_by_key", "select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) t where rn = 1")
_sql("ag12_smallest_k", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as rn from orders) t where rn <= 3")
_sql("ar02_filter", "select vec_id, LEN[FILTER[embedding;x > 0.1]] as n from embeddings")
_sql("ar04_max", "select doc_id, MAXOF[MAP[SPLIT[text; ];length(x)]] as n from documents")
_sql("ar13_count_equal", "select doc_id, LEN[FILTER[SPLIT[lower(text); ];x = 'the']] as n from documents")
_sql("ar17_divide", "select vec_id, round(SUM[MAP[VEC[embedding];x / 2e0]], 6) as s from embeddings")
_sql("st14_casts", "select o_orderkey, cast(floor(o_totalprice) as int) as whole, cast(o_custkey as string) as c, cast(o_orderkey as double) / 4 as q from orders")
_sql("st19_split_part", "select page_id, split_part(split_part(url, '://', 2), '/', 1) as host from pages")
_sql("mt01_scalars", "select event_id, round(sqrt(abs(value)), 6) as r, round(ln(1 + abs(value)), 6) as l, round(exp(-abs(value) / 100), 6) as e, cast(sign(value) as int) as s from events")
_sql("mt02_clamp", "select event_id, greatest(10e0, least(value, 60e0)) as v from events")
_sql("mt03_division", "select p_partkey, INTDIV[p_partkey;7] as q, p_partkey % 7 as r from part")
_sql("mt04_mask", "select p_partkey, p_size & -8 as m from part")
_sql("mt06_unit_to_u32", "select event_id, cast(round(greatest(0e0, least(1e0, (value - lo) / (hi - lo))) * 4294967295) as bigint) as u from events cross join (select min(value) as lo, max(value) as hi from events) s")
_sql("mt08_seeded_uniform", "select doc_id, HASH[concat('seed|', doc_id)] / 4294967296e0 as u from documents")

_CURVE = "(CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE 1.055 * pow(greatest({0}, 0.0031308e0), 1 / 2.4e0) - 0.055 END)"


@_df("mt07_transfer", "select p_partkey, round(case when p_size / 51e0 <= 0.04045 then p_size / 51e0 / 12.92 else pow((p_size / 51e0 + 0.055) / 1.055e0, 2.4e0) end, 6) as lin, round(" + _CURVE.format("(p_size / 51e0)") + ", 6) as s from part")
def _(spark, d):
    x = F.col("p_size") / 51.0
    return _table(spark, d, "part").select("p_partkey", F.round(colour.to_linear(x), 6).alias("lin"), F.round(colour.to_srgb(x), 6).alias("s"))


# Vector primitives
_V = "v as (select vec_id, label, VEC[embedding] as e from embeddings)"
_LONG = "l as (select vec_id, i, cast(AT[embedding;i] as double) as x from embeddings cross join (select EACH[SERIES[1;64]] as i) s)"


@_df("ve01_cosine", f"with {_PAIRS.format(q="q.vec_id % 100 = 0")} select qid, key, round(dist, 6) as dist from pairs")
def _(spark, d):
    return search.distances(_pool(spark, d), _asked(spark, d), digits=6)


@_df("ve03_normalize", "select vec_id, round(list_sum(list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))))), 6) as s from embeddings")
def _(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", F.round(vec.total(vec.l2_normalize(F.col("embedding"))), 6).alias("s"))


_sql("ve04_norm_stats", f"with {_V} select round(avg(n), 6) as m, round(min(n), 6) as lo, round(max(n), 6) as hi from (select sqrt(SUM[MAP[e;x * x]]) as n from v) t")


def _cut(bits: int) -> str:
    """DuckDB text of the coordinate ``x`` rounded to bfloat16 and cut to its upper ``bits``."""
    kept = f"((cast(round_even((abs(x) / pow(2e0, floor(log2(abs(x)))) - 1) * 128, 0) as bigint) + (cast(floor(log2(abs(x))) as bigint) + 127) * 128) & {(0xFFFF << (16 - bits)) & 0x7FFF})"
    return f"(case when x = 0 or {kept} < 128 then 0e0 else sign(x) * (1 + ({kept} % 128) / 128e0) * pow(2e0, {kept} // 128 - 127) end)"


for _name, _bits in (("ve05_bf16", 16), ("ve06_bf16_cut", 7)):

    @_df(_name, f"select vec_id, list_sum(list_transform(cast(embedding as double[]), lambda x: {_cut(_bits)} * 1048576e0)) as s from embeddings")
    def _(spark, d, bits=_bits):
        return _table(spark, d, "embeddings").select("vec_id", vec.total(F.transform(vec.to_bf16(F.col("embedding"), bits), lambda x: x * 1048576.0)).alias("s"))


@_df("ve07_truncated_distance", f"with v as (select vec_id, list_transform(cast(embedding[1:32] as double[]), lambda x: {_cut(7)}) as e, cast(embedding[1:32] as double[]) as r from embeddings) select q.vec_id as qid, p.vec_id as key, round(list_cosine_distance(p.e, q.r), 6) as dist from v p, v q where q.vec_id % 100 = 0 and p.vec_id <> q.vec_id")
def _(spark, d):
    pool = _pool(spark, d).withColumn("vec", F.slice(quant.bf16_cut(F.col("vec"), 7), 1, 32))
    return search.distances(pool, _asked(spark, d).withColumn("ref", F.slice("ref", 1, 32)), digits=6)


_sql("ve17_absmax_int8", f"with {_LONG}, m as (select i, max(abs(x)) as top from l group by i) select l.vec_id, cast(sum(round(x / top * 127)) as bigint) as s from l join m on l.i = m.i where top > 0 group by l.vec_id")
_sql("ve24_prefix", f"with {_V} select vec_id, round(sqrt(SUM[MAP[PART[e;1;16];x * x]]), 6) as n from v")


@_df("ve15_encode", f"select vec_id, cast(list_sum(list_transform(cast(embedding as double[]), lambda x: len(list_filter({quant.gaussian_codebook(4)[0]}, lambda t: t <= x * 8)))) as bigint) as s from embeddings")
def _(spark, d):
    codes = _table(spark, d, "embeddings").select("vec_id", quant.encode(F.col("embedding"), 4, 8.0).alias("c"))
    return codes.select("vec_id", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


@_df("ve18_float8", "select vec_id, list_sum(list_transform(cast(embedding as double[]), lambda x: case when x = 0 then 0e0 else sign(x) * least(448e0, ceil(abs(x) / pow(2e0, greatest(floor(log2(abs(x))), -6) - 3) - 0.5) * pow(2e0, greatest(floor(log2(abs(x))), -6) - 3)) end)) as s from embeddings")
def _(spark, d):
    e = vec.doubles(F.col("embedding"))
    return _table(spark, d, "embeddings").select("vec_id", vec.total(F.transform(e, lambda x: quant.float8(x, 3, -6, 448.0))).alias("s"))


@_df("ve19_quantile_codebook", f"with {_LONG}, c as (select i, ntile(16) over (partition by i order by x, vec_id) as code, x from l) select i, code, round(avg(x), 6) as level from c group by i, code")
def _(spark, d):
    """Sixteen cells of equal counts by coordinate and their means; cells are found from row numbers over all coordinates, in ranges."""
    cells = 16
    x = _table(spark, d, "embeddings").select("vec_id", F.posexplode(vec.doubles(F.col("embedding"))).alias("p", "x")).select("vec_id", (F.col("p") + 1).cast("long").alias("i"), "x")
    numbered = ranks.row_numbers(x, ["i", "x", "vec_id"])
    firsts = numbered.groupBy("i").agg(F.min("rn").alias("first"), F.count("*").alias("n"))
    at = numbered.join(F.broadcast(firsts), "i").withColumn("at", F.col("rn") - F.col("first"))  # a row per coordinate
    wide = F.expr(f"n % {cells} * (n div {cells} + 1)")  # rows in the first cells, which have one more
    code = F.when(F.col("at") < wide, F.expr(f"at div (n div {cells} + 1)")).otherwise(F.expr(f"n % {cells}") + F.floor((F.col("at") - wide) / F.expr(f"greatest(n div {cells}, 1)"))) + 1
    return at.groupBy("i", code.alias("code")).agg(F.round(F.avg("x"), 6).alias("level"))


_SIGN_ROWS = [[int(s) for s in vec.signs(64, f"project|{r}")] for r in range(8)]


@_df("ve23_sign_projection", "select vec_id, " + ", ".join(f"round(list_inner_product(cast(embedding as double[]), cast({r} as double[])) / sqrt(8), 6) as p{k}" for k, r in enumerate(_SIGN_ROWS)) + " from embeddings")
def _(spark, d):
    p = _table(spark, d, "embeddings").select("vec_id", quant.sign_projection(F.col("embedding"), 64, 8).alias("p"))
    return p.select("vec_id", *[F.round(F.col("p")[k], 6).alias(f"p{k}") for k in range(8)])


@_df("ve26_simhash", "select vec_id, " + " + ".join(f"(case when list_inner_product(cast(embedding as double[]), cast({r} as double[])) >= 0 then {1 << k} else 0 end)" for k, r in enumerate(_SIGN_ROWS)) + " as code from embeddings")
def _(spark, d):
    p = _table(spark, d, "embeddings").select("vec_id", quant.sign_projection(F.col("embedding"), 64, 8).alias("p"))
    return p.select("vec_id", sum(F.when(F.col("p")[k] >= 0, 1 << k).otherwise(0) for k in range(8)).alias("code"))


@_df("ve25_pca")
def _(spark, d):
    """Variance along the three leading axes, of all vectors."""
    e = _table(spark, d, "embeddings")
    axes = gram.principal_axes(e, F.col("embedding"), 3)
    p = e.select(*[vec.dot(F.col("embedding"), F.lit([float(x) for x in a])).alias(f"a{k}") for k, a in enumerate(axes)])
    return p.agg(*[F.round(F.var_pop(f"a{k}"), 6).alias(f"v{k}") for k in range(3)])


# Search reports
_PAIRS1 = "v as (select vec_id, VEC[embedding] as e from embeddings), q as (select e as r from v where vec_id = 0), pairs as (select vec_id as key, 1 - DOT[e;r;64] / sqrt(DOT[e;e;64] * DOT[r;r;64]) as dist from v cross join q where vec_id <> 0)"
_sql("se05_candidates_keyword", f"with {_PAIRS1}, c as (select key, pairs.dist as dist from pairs order by pairs.dist, key limit 200) select d.doc_id, round(c.dist, 6) as dist, d.text ilike '%the%' as hit from c join documents d on d.doc_id = c.key")
_MAP = f"with {_V}, m as (select vec_id, label, SUM[PART[e;1;32]] as x, SUM[PART[e;33;32]] as y from v)"
_sql("se07_nearest_point", f"{_MAP} select vec_id, label from m where x between -2 and 2 and y between -2 and 2 order by x * x + y * y, vec_id limit 1")

# Representation studies


@_df("rp11_cka", "with l as (select vec_id, unnest(range(1, 65)) as i, unnest(cast(embedding as double[])) as x from embeddings), g as (select a.i as i, b.i as j, sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*) as c from l a join l b using (vec_id) group by a.i, b.i) select round(sum(case when i <= 32 then c * c end) / sqrt(sum(case when i <= 32 and j <= 32 then c * c end) * sum(c * c)), 6) as cka from g")
def _(spark, d):
    return gram.linear_cka(_table(spark, d, "embeddings"), F.slice("embedding", 1, 32), F.col("embedding")).select(F.round("cka", 6).alias("cka"))


_sql("rp14_triplets", f"with {_V}, t as (select vec_id as a, HASH[concat('b', vec_id)] % n as b, HASH[concat('c', vec_id)] % n as c from embeddings cross join (select count(*) as n from embeddings) s), w as (select DOT[p.e;q.e;64] - DOT[p.e;r.e;64] as f, DOT[p.e;q.e;32] - DOT[p.e;r.e;32] as h from t join v p on p.vec_id = a join v q on q.vec_id = b join v r on r.vec_id = c where a <> b and a <> c and b <> c) select round(avg(case when (f > 0) = (h > 0) then 1e0 else 0e0 end), 6) as agreement, count(*) as n from w")
_sql("rp21_integrity", "select coalesce(a.k, b.k) as k, coalesce(n, 0) = coalesce(m, 0) as whole from (select doc_id as k, count(*) as n from documents group by doc_id) a full join (select doc_id as k, count(*) as m from labels group by doc_id) b on a.k = b.k")


# Models
_sql("ml06_standardize", f"with {_LONG}, m as (select i, avg(x) as mu, stddev_pop(x) as sd from l group by i) select l.vec_id, round(sum((x - mu) / greatest(sd, 1e-6)), 5) as s from l join m on l.i = m.i group by l.vec_id")

# Maps and colours
_DENSE = f"{_MAP}, c as (select cast(floor(greatest(0e0, least(0.999999e0, (x + 4) / 8)) * 32) as bigint) * 32 + cast(floor(greatest(0e0, least(0.999999e0, (y + 4) / 8)) * 32) as bigint) as pos, label from m), g as (select pos, count(*) as n, avg(label) as z from c group by pos)"
_A, _B = "(0.09e0 * cos(z / 10e0 * 2 * pi()))", "(0.09e0 * sin(z / 10e0 * 2 * pi()))"
_CONES = [f"pow({p} * l + {q} * {_A} + {r} * {_B}, 3)" for p, q, r in colour.LAB_TO_CONES]
_LIGHT = [f"greatest(0e0, least(1e0, {p} * c0 + {q} * c1 + {r} * c2))" for p, q, r in colour.CONES_TO_RGB]


@_df("mp02_colour", f"with g as (select label as z, count(*) as n from embeddings group by label), c as (select z, {', '.join(f'{c} as c{k}' for k, c in enumerate(_CONES))} from (select z, least(1e0, n / 100e0) as l from g) t), r as (select z, {', '.join(f'{x} as r{k}' for k, x in enumerate(_LIGHT))} from c) select z, {', '.join(f'round({_CURVE.format(f'r{k}')}, 5) as s{k}' for k in range(3))} from r")
def _(spark, d):
    g = _table(spark, d, "embeddings").groupBy(F.col("label").alias("z")).agg(F.count("*").alias("n"))
    rgb = colour.oklch_to_srgb(F.least(F.lit(1.0), F.col("n") / 100.0), F.lit(0.09), F.col("z") / 10.0)
    return g.select("z", *[F.round(x, 5).alias(f"s{k}") for k, x in enumerate(rgb)])


@_df("mp11_thumbnail")
def _(spark, d):
    """Every vector's bytes as a raster of 8 by 8 in grey, shrunk by area and by nearest pixel."""
    e = _table(spark, d, "embeddings")
    byte = F.transform("embedding", lambda x: F.lpad(F.hex((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 127 + 128).cast("int")), 2, "0"))
    raster = e.select("vec_id", F.unhex(F.array_join(F.transform(byte, lambda h: F.repeat(h, F.lit(3))), "")).alias("raster"))
    return raster.select("vec_id", F.hex(images.shrink_area(F.col("raster"), 8, 3)).alias("area"), F.hex(images.shrink_nearest(F.col("raster"), 8, 4)).alias("nearest"))


# Text
_sql("tx05_truncate", "select doc_id, concat('query: ', substr(text, 1, 8000)) as t from documents")
_sql("tx06_last_turn", "select conv_id, concat(role, chr(10), text) as t from (select *, row_number() over (partition by conv_id order by turn desc, text) as rn from conversations) x where rn = 1")


@_df("ud01_sql_function", "select vec_id, round(sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))), 6) as n from embeddings")
def _(spark, d):
    spark.sql("create or replace temporary function lumen_norm(v array<double>) returns double return sqrt(aggregate(v, 0D, (a, x) -> a + x * x))")
    return spark.sql("select vec_id, round(lumen_norm(cast(embedding as array<double>)), 6) as n from {e}", e=_table(spark, d, "embeddings"))

"""Summaries by quantiles and the constants of the map: exact by narrowing sketches, so no task holds a column's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.catalogue import _df, _table
from lumenvec.functions import vec
from lumenvec.operators import quantiles as qt
from lumenvec.studies import _DENSE, _MAP, _cut


def _rounded(df: DataFrame, by: list[str], names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*by, *[F.round(n, digits).alias(n) for n in names])


@_df("ag04_quantiles", "select event_type, round(QUANT[value;0.01], 6) as p01, round(QUANT[value;0.5], 6) as p50, round(QUANT[value;0.99], 6) as p99 from events group by event_type")
def _(spark, d):
    found = qt.quantiles(_table(spark, d, "events"), F.col("value"), {"p01": 0.01, "p50": 0.5, "p99": 0.99}, ["event_type"])
    return _rounded(found, ["event_type"], ["p01", "p50", "p99"])


@_df("ag04_sketch", "select event_type, count(value) as n, true as near from events group by event_type union all select 'all', count(value), true from events")
def _(spark, d):
    """A table of sketches by type, merged to that of all rows: the values that each holds, and whether its quantiles are within the rank
    error that is stated, by counting values below them."""
    events = _table(spark, d, "events").select("event_type", "value")
    by_type = qt.sketches(events, F.col("value"), ["event_type"])
    both = by_type.unionByName(qt.merged(by_type).withColumn("event_type", F.lit("all")))
    ranks = {f"r{k}": k / 10 for k in (1, 3, 5, 7, 9)}
    asked = qt.approximate(both, ranks).withColumn("n", F.kll_sketch_get_n_double("sketch")).drop("sketch")
    each = asked.select(F.col("event_type").alias("kind"), "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(c).alias("v")) for c, r in ranks.items()])).alias("q"))
    values = events.where("value is not null").withColumn("kind", F.explode(F.array("event_type", F.lit("all"))))
    met = values.join(F.broadcast(each), "kind")  # five rows for each type
    shares = met.groupBy("kind", "n", "q").agg(F.avg((F.col("value") < F.col("q.v")).cast("double")).alias("lo"), F.avg((F.col("value") <= F.col("q.v")).cast("double")).alias("hi"))
    near = F.min((F.col("lo") - qt.RANK_ERROR <= F.col("q.rank")) & (F.col("q.rank") <= F.col("hi") + qt.RANK_ERROR))
    return shares.groupBy(F.col("kind").alias("event_type"), "n").agg(near.alias("near"))


@_df("ag14_two_level", "select round(QUANT[n;0.9], 6) as q from (select user_id, cast(count(*) as double) as n from events group by user_id) t")
def _(spark, d):
    counts = _table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"))
    return _rounded(qt.quantiles(counts, F.col("n"), {"q": 0.9}), [], ["q"])


@_df("ag17_size_survey", "select source, round(avg(n_chars), 4) as mean, round(QUANT[cast(n_chars as double);0.5], 4) as median, max(case when rn = greatest(1, cast(floor(0.9e0 * n) as bigint)) then n_chars end) as p90, max(n_chars) as most, round(100e0 * count(n_chars) / max(total), 4) as coverage from (select source, n_chars, row_number() over (partition by source order by n_chars) as rn, count(*) over (partition by source) as n, t.total from documents cross join (select count(*) as total from documents) t) x group by source")
def _(spark, d):
    """Mean, median, the value nine tenths up the order, largest and share of all rows, by source."""
    docs = _table(spark, d, "documents").select("source", "n_chars")
    total = docs.count()
    sums = docs.groupBy("source").agg(F.round(F.avg("n_chars"), 4).alias("mean"), F.max("n_chars").alias("most"), F.round(100.0 * F.count("n_chars") / total, 4).alias("coverage"))
    # p90 is the order's place among all rows, nulls first where Spark puts them
    places = qt.quantiles(docs, F.col("n_chars"), {"median": 0.5, "p90": "greatest(1, floor(0.9D * n)) - 1"}, ["source"]).withColumnRenamed("source", "s")
    return sums.join(places, F.col("source").eqNullSafe(F.col("s"))).select("source", "mean", F.round("median", 4).alias("median"), F.col("p90").cast("long").alias("p90"), "most", "coverage")


@_df("mp08_quantile_hue", "select event_id, round(greatest(0e0, least(1e0, (value - lo) / (hi - lo))), 6) as hue from events cross join (select QUANT[value;0.01] as lo, QUANT[value;0.99] as hi from events) s")
def _(spark, d):
    events = _table(spark, d, "events")
    ends = qt.quantiles(events, F.col("value"), {"lo": 0.01, "hi": 0.99})
    return events.crossJoin(F.broadcast(ends)).select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))), 6).alias("hue"))


@_df("mp09_edge_clamp", "select round(100e0 * count_if(value <= lo or value >= hi) / count(*), 6) as pct from events cross join (select QUANT[value;0.001] as lo, QUANT[value;0.999] as hi from events) s")
def _(spark, d):
    events = _table(spark, d, "events")
    ends = qt.quantiles(events, F.col("value"), {"lo": 0.001, "hi": 0.999})
    return events.crossJoin(F.broadcast(ends)).agg(F.round(100.0 * F.count_if((F.col("value") <= F.col("lo")) | (F.col("value") >= F.col("hi"))) / F.count("*"), 6).alias("pct"))


@_df("se13_paired_similarity", f"select round(avg(c), 6) as m, round(min(c), 6) as lo, round(max(c), 6) as hi, round(quantile_cont(c, 0.1), 6) as p10 from (select 1 - list_cosine_distance(cast(embedding as double[]), list_transform(cast(embedding as double[]), lambda x: {_cut(9)})) as c from embeddings) t")
def _(spark, d):
    """The drift of a representation from another of the same rows (RP-17 asks the same)."""
    c = _table(spark, d, "embeddings").select((1 - vec.cosine_distance(F.col("embedding"), vec.to_bf16(F.col("embedding"), 9))).alias("c"))
    sums = c.agg(F.round(F.avg("c"), 6).alias("m"), F.round(F.min("c"), 6).alias("lo"), F.round(F.max("c"), 6).alias("hi"))
    return sums.crossJoin(_rounded(qt.quantiles(c, F.col("c"), {"p10": 0.1}), [], ["p10"]))  # a row each


@_df("rp17_drift", "select dims, round(avg(c), 6) as mean, round(quantile_cont(c, 0.5), 6) as median, round(quantile_cont(c, 0.1), 6) as p10 from (" + " union all ".join(f"select {n} as dims, list_inner_product(e[1:{n}], e[1:{n}]) / sqrt(list_inner_product(e[1:{n}], e[1:{n}]) * list_inner_product(e, e)) as c from (select cast(embedding as double[]) as e from embeddings) t" for n in (16, 32, 48)) + ") u group by dims")
def _(spark, d):
    """The cosine between a vector and its cut to fewer coordinates, the rest zero, by their number."""
    e = _table(spark, d, "embeddings").select(vec.doubles(F.col("embedding")).alias("e")).withColumn("n", vec.norm(F.col("e")))
    cosines = reduce(lambda a, b: a.unionByName(b), [e.select(F.lit(k).alias("dims"), (vec.norm(F.slice("e", 1, k)) / F.col("n")).alias("c")) for k in (16, 32, 48)])
    means = cosines.groupBy("dims").agg(F.round(F.avg("c"), 6).alias("mean"))
    return means.join(_rounded(qt.quantiles(cosines, F.col("c"), {"median": 0.5, "p10": 0.1}, ["dims"]), ["dims"], ["median", "p10"]), "dims")


# The map: each half of a vector summed to a coordinate
def _map(spark, d) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", "label", *[c.alias(n) for c, n in zip(vec.project3(F.col("embedding"), [(1, 32), (33, 32)]), "xy", strict=True)])


def _cell(c: str, cells: int):
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.999999), (F.col(c) + 4) / 8)) * cells)


@_df("mp06_density_quantile", f"{_DENSE} select round(QUANT[cast(n as double);0.99], 6) as q from g")
def _(spark, d):
    counts = _map(spark, d).groupBy((_cell("x", 32) * 32 + _cell("y", 32)).alias("pos")).agg(F.count("*").alias("n"))
    return _rounded(qt.quantiles(counts, F.col("n"), {"q": 0.99}), [], ["q"])


@_df("mp03_representative", f"{_MAP} select cell, min_by(vec_id, HASH[vec_id] * 1000000 + vec_id) as key, count(*) as n from (select vec_id, cast(floor(greatest(0e0, least(0.999999e0, (x + 4) / 8)) * 75) as bigint) * 75 + cast(floor(greatest(0e0, least(0.999999e0, (y + 4) / 8)) * 75) as bigint) as cell from m) c group by cell")
def _(spark, d):
    """One key for each cell of a map of 75 x 75 that has any: the least by hash."""
    cells = _map(spark, d).withColumn("cell", _cell("x", 75) * 75 + _cell("y", 75))
    return cells.groupBy("cell").agg(F.min(F.struct(vec.hash_int(F.col("vec_id")).alias("h"), F.col("vec_id").alias("key")))["key"].alias("key"), F.count("*").alias("n"))


@_df("mp05_render_constants", f"{_MAP} select round(min(x), 6) as x0, round(max(x), 6) as x1, round(min(y), 6) as y0, round(max(y), 6) as y1, round((min(x) + max(x)) / 2, 6) as cx, round((min(y) + max(y)) / 2, 6) as cy, round(2 / greatest(max(x) - min(x), max(y) - min(y)), 6) as scale, round(quantile_cont(cast(label as double), 0.01), 6) as c0, round(quantile_cont(cast(label as double), 0.99), 6) as c1 from m")
def _(spark, d):
    """The map's extent, its centre, one scale for both axes and the range of the colour."""
    m = _map(spark, d)
    ends = m.agg(*[f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))])
    centre = [F.round((F.col(f"{c}0") + F.col(f"{c}1")) / 2, 6).alias(f"c{c}") for c in "xy"]
    scale = F.round(2 / F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 6).alias("scale")
    colours = _rounded(qt.quantiles(m, F.col("label"), {"c0": 0.01, "c1": 0.99}), [], ["c0", "c1"])
    return ends.select(*[F.round(f"{c}{k}", 6).alias(f"{c}{k}") for c in "xy" for k in (0, 1)], *centre, scale).crossJoin(colours)  # a row each


@_df("mp07_projected_density", f"{_MAP} select cast(floor(greatest(0e0, least(1e0, x * 0.35 + 0.5)) * 1023) as bigint) * 1024 + cast(floor(greatest(0e0, least(1e0, y * 0.35 + 0.5)) * 1023) as bigint) as cell, count(*) as n, round(avg(label), 6) as z from m group by 1")
def _(spark, d):
    """Counts and mean colours on the projected grid, both axes."""
    side = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) * 0.35 + 0.5)) * 1023)
    return _map(spark, d).groupBy((side("x") * 1024 + side("y")).alias("cell")).agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("z"))

"""Quantiles from mergeable sketches: approximate in one pass, exact by narrowing the range that a sketch points to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a sketch: its ranks are off by less than ``RANK_ERROR`` of the rows, with a chance of 99 percent (a third of that at each of them).
SKETCH, RANK_ERROR = 1024, 0.008
#: Values that are put in order at once.
ORDERED = 1_000_000
#: Steps of the ranks at which a sketch is asked, and groups whose bounds may be broadcast.
GRID, BROADCAST_GROUPS = 256, 100_000


def sketches(df: DataFrame, value: Column, by: list[str] | None = None, size: int = SKETCH) -> DataFrame:
    """(by..., sketch): a sketch of each group's values, to be stored and merged; nulls take no part."""
    return df.select(*(by or []), value.cast("double").alias("__v")).groupBy(*(by or [])).agg(F.kll_sketch_agg_double("__v", F.lit(size)).alias("sketch"))


def merged(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketches of larger groups, or of all rows, from those of smaller ones."""
    return table.groupBy(*(by or [])).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def approximate(table: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """Sketches with a column for each of the named ranks, off by less than ``RANK_ERROR`` in rank."""
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(r)) for r in ranks.values()]))
    return table.withColumn("__q", grid).select(*[c for c in table.columns], *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(ranks)]).drop("__q")


def quantiles(df: DataFrame, value: Column, places: dict[str, str | float], by: list[str] | None = None, ordered: int = ORDERED) -> DataFrame:
    """(by..., and a column for each name of ``places``): exact quantiles, between two values by their distance.

    A place is a rank from 0 to 1, or SQL over ``n``, the number of values, for the place in order from 0. Nulls and NaN take no part; a
    group without values has null. Groups may have null keys.

    Each pass narrows the range in which a quantile lies by a sketch of the values in it, to about a fortieth of them, until at most
    ``ordered`` are left, or one; only these are put in order. So nothing is sorted whole, and no task holds more than that. Tables of at
    most ``ordered`` values need one pass.
    """
    by = by or []
    spark = df.sparkSession
    keys = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("k"))
    rows = df.select(keys.alias("__g"), value.cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    groups = df.select(keys.alias("__g")).distinct() if by else spark.range(1).select(keys.alias("__g"))
    counts = rows.groupBy("__g").agg(F.count("*").alias("n"))
    at = {name: f"{float(p)!r}D * (n - 1)" if not isinstance(p, str) else p for name, p in places.items()}
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(sql).cast("double").alias("at")) for name, sql in at.items()]))
    unknown = [F.lit(x).cast(t).alias(c) for c, x, t in (("lo", float("-inf"), "double"), ("hi", float("inf"), "double"), ("below", 0, "long"))]
    bounds = counts.select("__g", "n", listed.alias("p")).select("__g", "p.name", "p.at", *unknown, F.col("n").alias("inside"))

    def inside(which: DataFrame, n: int) -> DataFrame:
        b = which.withColumnRenamed("__g", "__b")
        return rows.join(F.broadcast(b) if n <= BROADCAST_GROUPS else b, F.col("__g").eqNullSafe(F.col("__b")) & F.col("__v").between(F.col("lo"), F.col("hi"))).drop("__b")

    held = _kept(bounds)
    while True:
        wide = held.where((F.col("inside") > ordered) & (F.col("lo") < F.col("hi")))
        n = wide.count()
        if not n:
            break
        grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
        sketch = inside(wide, n).groupBy("__g", "name").agg(F.kll_sketch_agg_double("__v", F.lit(SKETCH)).alias("s"), *[F.first(c).alias(c) for c in ("at", "lo", "hi", "below", "inside")])
        rank = (F.col("at") - F.col("below")) / F.col("inside")
        step = lambda r, up: (F.ceil(r * GRID) if up else F.floor(r * GRID)).cast("int")
        asked = sketch.withColumn("q", F.kll_sketch_get_quantile_double("s", grid)).select("__g", "name", "at", "lo", "hi", "below", "inside", F.when(rank > RANK_ERROR, F.get("q", step(rank - RANK_ERROR, False))).otherwise(F.col("lo")).alias("a"), F.when(rank < 1 - RANK_ERROR, F.get("q", step(rank + RANK_ERROR, True))).otherwise(F.col("hi")).alias("b"))
        asked = _kept(asked)
        met = inside(asked, n).groupBy("__g", "name").agg(*[F.first(c).alias(c) for c in ("at", "lo", "hi", "below", "inside", "a", "b")], F.count_if(F.col("__v") < F.col("a")).alias("under"), F.count_if(F.col("__v") <= F.col("b")).alias("upto"))
        # a bound that would leave the quantile out stays as it was; so does one that brings nothing
        fits_a, fits_b = F.col("below") + F.col("under") <= F.floor("at"), F.col("below") + F.col("upto") > F.ceil("at")
        under, upto = F.when(fits_a, F.col("under")).otherwise(0), F.when(fits_b, F.col("upto")).otherwise(F.col("inside"))
        now = met.select("__g", "name", "at", F.when(fits_a, F.col("a")).otherwise(F.col("lo")).alias("lo"), F.when(fits_b, F.col("b")).otherwise(F.col("hi")).alias("hi"), (F.col("below") + under).alias("below"), (upto - under).alias("inside"), (upto - under < F.col("inside")).alias("less"))
        now = _kept(now)
        narrower = now.where("less").drop("less")
        stuck = now.where("not less").drop("less").withColumn("inside", F.lit(0).cast("long"))  # many equal values: their counts are few rows
        held = _kept(held.join(wide.select("__g", "name"), (held["__g"].eqNullSafe(wide["__g"])) & (held["name"] == wide["name"]), "left_anti").unionByName(narrower).unionByName(stuck))
    total = held.count()
    values = inside(held, total).groupBy("__g", "name", "at", "below", "__v").agg(F.count("*").alias("c"))
    order = Window.partitionBy("__g", "name").orderBy("__v")
    places_ = values.withColumn("upto", F.col("below") + F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.min(F.when(F.col("upto") > F.floor("at"), F.col("__v")))
    high = F.min(F.when(F.col("upto") > F.ceil("at"), F.col("__v")))
    found = places_.groupBy("__g", "name").agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("q"))
    wide = found.groupBy(F.col("__g").alias("__f")).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in places])
    out = groups.join(wide, F.col("__g").eqNullSafe(F.col("__f")), "left")
    return out.select(*[F.col(f"__g.{b}").alias(b) for b in by], *places)


def _kept(df: DataFrame) -> DataFrame:
    """A small table of bounds, held so that each pass starts from numbers and not from the passes before; lost parts are made again."""
    return df.persist()

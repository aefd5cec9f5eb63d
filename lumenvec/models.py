"""Queries over trained models: stored fit states, a grid of mini-batch settings, a balanced classifier with its report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.catalogue import _df, _table
from lumenvec.exchange import scratch
from lumenvec.functions import vec
from lumenvec.operators import fit_state as fs
from lumenvec.operators import ranks, sgd

def _hash() -> Column:
    return vec.hash_int(F.col("vec_id"))


_LOADS = "select load, i, j, cast(round(sum(zi * zj), 6) as double) as s from (select vec_id, vec_id % 2 as load, i, cast(z[i + 1] as double) as zi from z cross join (select unnest(range(0, 66)) as i) a) a join (select vec_id as v, j, cast(z[j + 1] as double) as zj from z cross join (select unnest(range(0, 66)) as j) b) b on vec_id = v and i <= j group by load, i, j"


def _state_rows(spark, d) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 2).alias("load"), vec.doubles(F.col("embedding")).alias("x"))


@_df("ag20_fit_state", f"with z as (select vec_id, list_concat(list_concat([1e0], cast(embedding as double[])), [cast(label as double)]) as z from embeddings) {_LOADS}")
def _(spark, d):
    """The states of two loads over all 64 features, with the label as target, stored and read back."""
    path = scratch(spark, "state")
    fs.fit_state(_state_rows(spark, d), F.col("x"), F.col("label"), by=["load"]).write.partitionBy("load").parquet(path)
    return spark.read.schema("i int, j int, s double, load long").parquet(path).select("load", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("s", 6).alias("s"))


#: Two features, each half of the coordinates; balanced weights; sums for the 3 x 3 normal equations of one Newton step on the training rows.
_STEP = """f as (select vec_id, label, HASH[vec_id] % 4 <> 0 as train, case when label < 3 then 1e0 else 0e0 end as y, list_sum(cast(embedding[1:32] as double[])) as a, list_sum(cast(embedding[33:64] as double[])) as b from embeddings),
k as (select count(*) / (2e0 * sum(y)) as w1, count(*) / (2e0 * sum(1 - y)) as w0 from f where train),
g as (select sum(w) as s, sum(w * a) as sa, sum(w * b) as sb, sum(w * a * a) as aa, sum(w * a * b) as ab, sum(w * b * b) as bb, sum(w * (y - 0.5)) as r, sum(w * a * (y - 0.5)) as ra, sum(w * b * (y - 0.5)) as rb from (select f.*, case when y = 1 then w1 else w0 end as w from f cross join k where train) t),
dt as (select *, s * (aa * bb - ab * ab) - sa * (sa * bb - ab * sb) + sb * (sa * ab - aa * sb) as det from g),
m as (select 4 * (r * (aa * bb - ab * ab) - sa * (ra * bb - ab * rb) + sb * (ra * ab - aa * rb)) / det as w0, 4 * (s * (ra * bb - ab * rb) - r * (sa * bb - ab * sb) + sb * (sa * rb - ra * sb)) / det as wa, 4 * (s * (aa * rb - ra * ab) - sa * (sa * rb - ra * sb) + r * (sa * ab - aa * sb)) / det as wb from dt),
p as (select vec_id, label, y, train, 1 / (1 + exp(-(m.w0 + wa * a + wb * b))) as p from f cross join m)"""


def _trained(spark, d) -> DataFrame:
    """(vec_id, label, y, train, p): chances of label under 3 by the first Newton step of a class-weighted logistic fit to three quarters of the rows."""
    a, b = vec.project3(F.col("embedding"), [(1, 32), (33, 32)])
    rows = _table(spark, d, "embeddings").select("vec_id", "label", (_hash() % 4 != 0).alias("train"), (F.col("label") < 3).cast("int").alias("y"), F.array(a, b).alias("x"))
    n = rows.where("train").groupBy("y").count().collect()  # two rows
    weight = reduce(lambda c, r: c.when(F.col("y") == r["y"], sum(x["count"] for x in n) / (2.0 * r["count"])), n, F.when(F.lit(False), 1.0))
    w = fs.solve_logistic_step(fs.fit_state(rows.where("train"), F.col("x"), F.col("y"), weight))
    return rows.select("vec_id", "label", "y", "train", fs.probability(F.col("x"), w).alias("p"))


@_df("ml05_sigmoid_scores", f"with {_STEP} select vec_id, round(p, 6) as p from p")
def _(spark, d):
    """The chances of all rows as a table."""
    return _trained(spark, d).select("vec_id", F.round("p", 6).alias("p"))


@_df("ml08_evaluate", f"with {_STEP} select round(avg(case when (p > 0.5) = (y = 1) then 1e0 else 0e0 end), 6) as acc, round(avg(p), 6) as mean, round(stddev_pop(p), 6) as sd, count(*) as n from p where not train")
def _(spark, d):
    held = _trained(spark, d).where("not train")
    return held.agg(F.round(F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")), 6).alias("acc"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_pop("p"), 6).alias("sd"), F.count("*").alias("n"))


@_df("ml12_auc", f"with {_STEP} select round((sum(case when y = 1 then r else 0 end) - np * (np + 1) / 2) / (np * nn), 6) as auc from (select y, rank() over (order by round(p, 12)) + (count(*) over (partition by round(p, 12)) - 1) / 2e0 as r, sum(y) over () as np, sum(1 - y) over () as nn from p where not train) t group by np, nn")
def _(spark, d):
    """The rank-sum form on the held-out quarter."""
    sums = ranks.average_ranks(_trained(spark, d).where("not train").select("y", F.round("p", 12).alias("p")), "p").agg(F.sum(F.when(F.col("y") == 1, F.col("r")).otherwise(0.0)).alias("s"), F.sum("y").alias("np"), F.sum(1 - F.col("y")).alias("nn"))
    return sums.select(F.round((F.col("s") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn")), 6).alias("auc"))


@_df("ml12_confusion", f"with {_STEP} select y as truth, case when p > 0.5 then 1 else 0 end as guess, count(*) as n from p where not train group by 1, 2")
def _(spark, d):
    return _trained(spark, d).where("not train").groupBy(F.col("y").cast("double").alias("truth"), (F.col("p") > 0.5).cast("int").alias("guess")).agg(F.count("*").alias("n"))


@_df("ud02_apply_state", f"with {_STEP.split('k as')[0].replace('case when label < 3 then 1e0 else 0e0 end', 'cast(label as double)')} g as (select sum(1e0) as s, sum(a) as sa, sum(b) as sb, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(y) as r, sum(a * y) as ra, sum(b * y) as rb from f where train), " + _STEP[_STEP.index("dt as") :].split("p as")[0].replace("4 * ", "").rstrip(",\n ") + " select vec_id, round(m.w0 + wa * a + wb * b, 6) as fitted from f cross join m where not train")
def _(spark, d):
    """States of two loads of the training rows, merged and solved when they are applied to the rows that neither has seen."""
    a, b = vec.project3(F.col("embedding"), [(1, 32), (33, 32)])
    rows = _table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 2).alias("load"), (_hash() % 4 != 0).alias("train"), F.array(a, b).alias("x"))
    path = scratch(spark, "state")
    for load in (0, 1):
        fs.fit_state(rows.where(f"train and load = {load}"), F.col("x"), F.col("label")).write.mode("append").parquet(path)
    w = fs.solve(fs.merge(spark.read.schema(fs.STATE).parquet(path)))
    return rows.where("not train").select("vec_id", F.round(fs.linear(F.col("x"), w), 6).alias("fitted"))


#: The grid of ML-07: rate, penalty, batches a pass, method.
GRID = [sgd.Setting(0.05, 0.001, 8, "Adam"), sgd.Setting(0.02, 0.0, 8, "Adam"), sgd.Setting(0.5, 0.001, 4, "SGD"), sgd.Setting(0.2, 0.0, 8, "Momentum"), sgd.Setting(0.2, 0.01, 2, "Nesterov")]
EPOCHS = 6


@_df("ml07_sgd_grid")
def _(spark, d):
    """Held-out figures of five settings, trained together over hashed mini-batches on three quarters of the rows, features standardised."""
    e = _table(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("y"), vec.doubles(F.col("embedding")).alias("x"), (_hash() % 4 != 0).alias("train"))
    stats = e.where("train").select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")).orderBy("i").collect()  # a row per feature
    mu, sd = F.lit([float(r["mu"]) for r in stats]), F.lit([max(float(r["sd"]), 1e-6) for r in stats])
    z = F.zip_with(F.zip_with("x", mu, lambda x, m: x - m), sd, lambda x, s: x / s)
    rows = e.select(F.col("vec_id").alias("id"), "y", "train", z.alias("x"))
    path = scratch(spark, "sgd")
    sgd.write_batches(rows.where("train").withColumn("weight", F.lit(1.0)), f"{path}/batches", 8)
    w = sgd.train(spark, f"{path}/batches", GRID, len(stats), EPOCHS, f"{path}/weights")
    chances = F.array(*[F.get(sgd.scores(F.col("x"), s), F.lit(0)) for s in w])
    each = rows.where("not train").select("y", F.posexplode(chances).alias("setting", "p"))
    return each.groupBy("setting").agg(F.round(F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")), 6).alias("acc"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_pop("p"), 6).alias("sd"), F.count("*").alias("n"))


def softmax_split(spark, d) -> DataFrame:
    """(vec_id, y, x, train): three quarters of each class by hash; ties of the hash by id. Ranks are those of ranges, so no class is one task's."""
    e = _table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), vec.doubles(F.col("embedding")).alias("x"), _hash().alias("h"))
    numbered = ranks.row_numbers(e, ["y", "h", "vec_id"])
    firsts = numbered.groupBy("y").agg(F.min("rn").alias("first"), F.count("*").alias("n"))  # a row per class
    return numbered.join(firsts, "y").select("vec_id", "y", "x", (F.col("rn") - F.col("first") + 1 <= F.ceil(0.75 * F.col("n"))).alias("train"))


@_df("ml09_balanced_report")
def _(spark, d):
    """Confusion matrix and report of a class-weighted softmax regression on the held-out quarter of a stratified split: each pair of truth
    and guess with its count, the truth's precision, recall and F1, and the macro F1."""
    path = scratch(spark, "softmax")
    softmax_split(spark, d).write.parquet(f"{path}/split")
    rows = spark.read.parquet(f"{path}/split")
    counts = rows.where("train and y is not null").groupBy("y").count().orderBy("y").collect()  # a row per class
    classes = [r["y"] for r in counts]
    known = rows.where(F.col("y").isin(classes))
    place = reduce(lambda c, k: c.when(F.col("y") == k[1], k[0]), list(enumerate(classes)), F.when(F.lit(False), 0))
    weight = reduce(lambda c, k: c.when(F.col("y") == k["y"], sum(r["count"] for r in counts) / (len(classes) * k["count"])), counts, F.when(F.lit(False), 1.0))
    sgd.write_batches(known.where("train").select(F.col("vec_id").alias("id"), "x", place.alias("y"), weight.alias("weight")), f"{path}/batches", 4)
    w = sgd.train(spark, f"{path}/batches", [sgd.Setting(0.2, 0.0005, 4, "Adam")], 64, 12, f"{path}/weights", classes=len(classes))[0]
    p = sgd.scores(F.col("x"), w)
    guessed = known.where("not train").withColumn("p", p).select("y", F.get(F.lit([int(c) for c in classes]), (F.array_position("p", F.array_max("p")) - 1).cast("int")).alias("guess"))
    return report(guessed.groupBy(F.col("y").alias("truth"), "guess").agg(F.count("*").alias("n")))


def report(confusion: DataFrame) -> DataFrame:
    """(truth, guess, n) with precision, recall and f1 of each truth and macro_f1; a class that is never guessed has precision 0."""
    right = confusion.where("truth = guess").select("truth", F.col("n").alias("hit"))
    by_truth = confusion.groupBy("truth").agg(F.sum("n").alias("have"))
    by_guess = confusion.groupBy(F.col("guess").alias("truth")).agg(F.sum("n").alias("said"))
    per = by_truth.join(by_guess, "truth", "left").join(right, "truth", "left").fillna(0, ["said", "hit"])
    per = per.select("truth", F.round(F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), 6).alias("precision"), F.round(F.col("hit") / F.col("have"), 6).alias("recall"), F.round(2 * F.col("hit") / (F.col("have") + F.col("said")), 6).alias("f1"))
    return confusion.join(per, "truth").crossJoin(per.agg(F.round(F.avg("f1"), 6).alias("macro_f1")))


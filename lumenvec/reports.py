"""Queries of the catalogue on projections, reports between representations, size variants and the words of records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenvec.catalogue import ORACLE_SQL, _asked, _df, _pool, _sql, _table, top_words
from lumenvec.exchange import scratch
from lumenvec.functions import projections, vec
from lumenvec.operators import blocks, images, search

_sql("ar07_distinct", "select doc_id, LEN[DISTINCT[SPLIT[text; ]]] as n from documents where text is not null")
_sql("st02_lower", "select c_custkey, lower(c_mktsegment) as segment, lower(c_name) as name from customer")
_sql("ml02_argmax", "select vec_id, cast(PLACE[embedding;MAXOF[embedding]] as int) as c from embeddings")

# The suffix of each size, and the units of human-readable sizes
_SMALL = {"sq": "_s", "q": "_q", "t": "_t", "s": "_m", "n": "_n", "w": "_w", "m": "", "z": "_z", "c": "_c", "l": "_b"}
_BIG = {"h": "_h", "k": "_k", "3k": "_3k", "4k": "_4k", "5k": "_5k", "6k": "_6k"}
_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]

_SIZES = " union all ".join(f"select '{size}' as size, '{end}' as suffix, {big} as big" for big, table in (("false", _SMALL), ("true", _BIG)) for size, end in table.items())
#: A large size has a secret of its own; ``-`` stands for a size that is missing and has no url.
_sql("st16_size_variants", f"select p_partkey, size, case when not big then concat('/', p_size, '/', p_partkey, '_', substr(md5(p_name), 1, 10), suffix, '.jpg') when secret <> '-' then concat('/', p_size, '/', p_partkey, '_', secret, suffix, '.jpg') end as url from (select p_partkey, p_size, p_name, case when p_size > 25 then substr(md5(concat('big', p_name)), 1, 10) else '-' end as secret from part) p cross join ({_SIZES}) s")
_STEP = "case " + " ".join(f"when n < {1024 ** (k + 1)} then {k}" for k in range(5)) + " else 5 end"
_sql("st18_human_size", f"select p_partkey, concat(cast(cast(n / pow(1024e0, {_STEP}) as decimal(20,1)) as string), ' ', case {_STEP} " + " ".join(f"when {k} then '{u}'" for k, u in enumerate(_UNITS)) + " end) as size from (select p_partkey, cast(p_partkey as bigint) * p_partkey * p_size * 1000 as n from part) t")


@_df("mp04_words_tile", "with top as (" + ORACLE_SQL["tx04_top_words"] + "), m as (select vec_id, list_sum(cast(embedding[1:32] as double[])) as x, list_sum(cast(embedding[33:64] as double[])) as y from embeddings) select vec_id, round(x, 6) as x, round(y, 6) as y, rank, token from m join top on vec_id = doc_id where x between -2 and 2 and y between -2 and 2")
def _(spark, d):
    """The top words of every record in one tile of the map; words are counted over all texts and ranked for the tile's records alone."""
    e = F.col("embedding")
    at = _table(spark, d, "embeddings").select("vec_id", *[c.alias(n) for c, n in zip(vec.project3(e, [(1, 32), (33, 32)]), "xy")]).where("x between -2 and 2 and y between -2 and 2")
    words = top_words(spark, d, at.select(F.col("vec_id").alias("doc_id")))
    return at.join(words, at.vec_id == words.doc_id).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "rank", "token")


@_df("se08_click", "with v as (select vec_id, cast(embedding as double[]) as e from embeddings), c as (select e from v order by pow(list_sum(e[1:32]), 2) + pow(list_sum(e[33:64]), 2), vec_id limit 1), n as (select vec_id, list_cosine_distance(v.e, c.e) as dist from v cross join c order by dist, vec_id limit 100) select doc_id, lang, source, round(dist, 6) as dist from n join documents on doc_id = vec_id")
def _(spark, d):
    """The nearest point on the map to a click at its origin, its 100 nearest by cosine (itself too), and their metadata."""
    e = _table(spark, d, "embeddings").select("vec_id", vec.doubles(F.col("embedding")).alias("e"))
    x, y = vec.project3(F.col("e"), [(1, 32), (33, 32)])
    clicked = e.orderBy(x * x + y * y, "vec_id").limit(1).select(F.col("e").alias("ref"))
    near = e.crossJoin(F.broadcast(clicked)).select("vec_id", vec.cosine_distance(F.col("e"), F.col("ref")).alias("dist")).orderBy("dist", "vec_id").limit(100)
    docs = _table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.join(F.broadcast(near), F.col("doc_id") == F.col("vec_id")).select("doc_id", "lang", "source", F.round("dist", 6).alias("dist"))


_ASIDE = "v as (select vec_id, cast(embedding as double[]) as e from embeddings), s as (select vec_id as qid, list_concat(e[1:24], list_transform(range(40), lambda i: 0e0)) as f from v where vec_id % 100 = 0), c as (select qid, vec_id as key, list_cosine_distance(f, e) as dist from s cross join v)"


def _aside(spark, d):
    """A poorer variant of each hundredth vector (24 coordinates kept) against the whole catalogue, its own row too."""
    pool, asked = _pool(spark, d), _table(spark, d, "embeddings").where("vec_id % 100 = 0")
    asked = asked.select(F.col("vec_id").alias("qid"), F.concat(F.slice(vec.doubles(F.col("embedding")), 1, 24), F.array_repeat(F.lit(0.0), 40)).alias("ref"))
    return pool, asked


@_df("se11_cross_size", f"with {_ASIDE}, r as (select *, row_number() over (partition by qid order by dist, key) as rk from c) select round(avg(case when rk <= 1 then 1e0 else 0e0 end), 6) as at1, round(avg(case when rk <= 5 then 1e0 else 0e0 end), 6) as at5 from r where key = qid")
def _(spark, d):
    pool, asked = _aside(spark, d)
    found = search.exact(pool, asked, 5, own=True).where("key = qid").select("qid", "rank")
    ranks = asked.select("qid").join(found, "qid", "left")
    return ranks.agg(*[F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"at{k}") for k in (1, 5)])


@_df("se12_cross_modal", f"with {_ASIDE} select round(avg(case when hit then 1e0 else 0e0 end), 6) as at1, round(avg(own), 6) as matching, round(avg(others), 6) as others, round(avg(own) - avg(others), 6) as gap from (select qid, arg_min(key, dist) = qid as hit, max(case when key = qid then 1 - dist end) as own, avg(case when key <> qid then 1 - dist end) as others from c group by qid) t")
def _(spark, d):
    pool, asked = _aside(spark, d)

    def visit(q: blocks.Block, parts: Iterator[blocks.Block]) -> Iterator[pa.RecordBatch]:
        """For each query of a block the nearest of a part, the cosine to its own row, and number and sum of the others."""
        best, own = blocks.Nearest(q, 1, own=True), np.full(len(q.keys), np.nan)
        n, total = np.zeros(len(q.keys), np.int64), np.zeros(len(q.keys))
        for p in parts:
            dist = blocks.cosine_distances(p, q)
            best.add(p, [dist])
            mine, live = q.keys[:, None] == p.keys[None, :], ~np.isnan(dist)
            own = np.fmax(own, np.where(mine & live, 1 - dist, -np.inf).max(1))
            n, total = n + (live & ~mine).sum(1), total + np.where(live & ~mine, 1 - dist, 0).sum(1)
        own[~np.isfinite(own)] = np.nan
        dist, key = (x[:, 0] for x in best.found(0))
        yield pa.RecordBatch.from_arrays([pa.array(q.keys), pa.array(dist, from_pandas=True), pa.array(key), pa.array(own, from_pandas=True), pa.array(n), pa.array(total)], ["qid", "dist", "key", "own", "n", "total"])

    parts = blocks.meet(pool, asked, visit, "qid long, dist double, key long, own double, n long, total double")
    first = F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", "key")))["key"]
    by = parts.groupBy("qid").agg((first == F.col("qid")).alias("hit"), F.max("own").alias("own"), (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("others"))
    m, o = F.avg("own"), F.avg("others")
    return by.agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("at1"), F.round(m, 6).alias("matching"), F.round(o, 6).alias("others"), F.round(m - o, 6).alias("gap"))


_sql("tk12_extreme_pairs", "with l as (select label, i, avg(cast(AT[embedding;i] as double)) as x from embeddings cross join (select EACH[SERIES[1;64]] as i) s group by label, i), p as (select a.label as a, b.label as b, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) as c from l a join l b on a.i = b.i and a.label < b.label group by a.label, b.label), r as (select *, row_number() over (order by c desc, a, b) as top, row_number() over (order by c, a, b) as low from p) select a, b, round(c, 6) as c from r where top <= 5 or low <= 5")


@_df("ml13_export_weights")
def _(spark, d):
    """The weights of a multinomial logistic regression as a table: class, feature (0 is the intercept), weight."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    e = _table(spark, d, "embeddings").select(F.col("label").cast("double").alias("label"), array_to_vector(vec.doubles(F.col("embedding"))).alias("features"))
    model = LogisticRegression(maxIter=30, regParam=0.01, family="multinomial").fit(e)
    rows = [(c, j, float(x)) for c, (b, w) in enumerate(zip(model.interceptVector, model.coefficientMatrix.toArray())) for j, x in enumerate([b, *w])]
    return spark.createDataFrame(rows, "class int, feature int, weight double")


_HADAMARD = " + ".join(f"pow(list_inner_product(e, cast({[float(x) for x in r]} as double[])), 2)" for r in projections.hadamard_rows(64, 32))


@_df("ve13_subsampled_hadamard", f"select round(avg(({_HADAMARD}) / list_inner_product(e, e)), 6) as ratio, count(*) as rows from (select cast(embedding as double[]) as e from embeddings) t where list_inner_product(e, e) > 0")
def _(spark, d):
    """Mean ratio of squared lengths after and before the transform with half of the columns."""
    e = _table(spark, d, "embeddings").select(vec.dot(F.col("embedding"), F.col("embedding")).alias("n"), projections.subsampled_hadamard(F.col("embedding"), 64, 32).alias("p"))
    return e.where("n > 0").agg(F.round(F.avg(vec.dot(F.col("p"), F.col("p")) / F.col("n")), 6).alias("ratio"), F.count("*").alias("rows"))


_ROWS = {kind: projections.matrix(kind, 4, 64) for kind in projections.KINDS}


@_df("ve23_projections", "with v as (select vec_id, cast(embedding as double[]) as e from embeddings) " + " union all ".join(f"select vec_id, '{kind}' as kind, round({' + '.join(f'list_inner_product(e, cast({[float(x) for x in r]} as double[])) * {k + 1}' for k, r in enumerate(rows))}, 6) as s from v" for kind, rows in _ROWS.items()))
def _(spark, d):
    """Four projections of every vector by each kind of matrix, as one weighted sum."""
    e = _table(spark, d, "embeddings")
    weighted = lambda kind: vec.dot(projections.project(F.col("embedding"), _ROWS[kind]), F.lit([1.0, 2.0, 3.0, 4.0]))
    return reduce(lambda a, b: a.unionByName(b), [e.select("vec_id", F.lit(k).alias("kind"), F.round(weighted(k), 6).alias("s")) for k in projections.KINDS])


@_df("ve26_expansion")
def _(spark, d):
    """Recall at 10 of one-bit codes after expansion by Gaussian rows and by a tight frame of two bases."""
    plans = [("gaussian", x, projections.matrix("gaussian", int(64 * x), 64)) for x in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)] + [("frame", 2.0, projections.matrix("orthogonal", 128, 64))]
    coded = lambda df, key, c: df.select(key, c, *[projections.project(F.col(c), rows, codes=True).alias(f"p{i}") for i, (_, _, rows) in enumerate(plans)])
    score = lambda p, q: [blocks.cosine_distances(p, q, i, i) for i in (*range(1, len(plans) + 1), 0)]
    path = scratch(spark, "expansion")
    blocks.nearest(coded(_pool(spark, d), "key", "vec"), coded(_asked(spark, d), "qid", "ref"), score, 10).write.parquet(path)
    names = spark.createDataFrame([(i, kind, x) for i, (kind, x, _) in enumerate(plans)], "cell int, kind string, times double")
    return F.broadcast(names).join(search.cell_recall(spark.read.parquet(path), len(plans), 10), "cell").drop("cell")


@_df("mp11_lanczos")
def _(spark, d):
    """Every vector's bytes as a raster of 8 by 8 in grey: the middle square by area and Lanczos to 2 by 2."""
    byte = F.transform("embedding", lambda x: F.lpad(F.hex((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 127 + 128).cast("int")), 2, "0"))
    raster = F.unhex(F.array_join(F.transform(byte, lambda h: F.repeat(h, F.lit(3))), ""))
    return _table(spark, d, "embeddings").select("vec_id", F.hex(images.shrink_lanczos(raster, 8, 8, 2)).alias("thumb"))

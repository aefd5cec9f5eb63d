"""Queries over stored copies: vector files, Z-ordered tiles, logged loads, patches, bucketed joins. Each writes its whole table and reads it back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenvec.catalogue import _PAIRS, QUERIES, _df, _table
from lumenvec.exchange import scratch
from lumenvec.plans import loads, tiles
from lumenvec.sources import vector_files as vf


def _files(spark: SparkSession, rows: DataFrame, kind: str) -> DataFrame:
    """Rows written as files of a format, in their order, and read back."""
    path = scratch(spark, kind)
    vf.write_vector_files(rows, path, kind)
    return vf.read_vector_files(spark, path, kind)


_IDS = "row_number() over (order by vec_id) - 1 as id"
_BYTE = {"u8bin": ("greatest(0, least(255, round_even(x * 127 + 128, 0)))", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(x * 127 + 128)))), "i8bin": ("round_even(x * 127, 0)", lambda x: F.rint(x * 127))}
_BYTE["bvecs"] = _BYTE["u8bin"]


@_df("sc11_fbin", f"select {_IDS}, len(embedding) as n, round(SUM[VEC[embedding]], 6) as s from embeddings")
def _(spark, d):
    """Vectors in the order of their ids as float files of several tasks; ids are the places of the rows."""
    back = _files(spark, _table(spark, d, "embeddings").orderBy("vec_id").select(F.col("embedding").alias("vec")), "fbin")
    return back.select("id", F.size("vec").cast("long").alias("n"), F.round(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


for _name, _kind in (("sc11_u8bin", "u8bin"), ("sc11_i8bin", "i8bin"), ("sc12_bvecs", "bvecs")):

    @_df(_name, f"select {_IDS}, SUM[list_transform(VEC[embedding], lambda x: {_BYTE[_kind][0]})] as s, SUM[list_transform(VEC[embedding], lambda x: pow({_BYTE[_kind][0]}, 2))] as q from embeddings")
    def _(spark, d, kind=_kind):
        """Vectors as whole numbers of one byte; sums of the numbers and of their squares."""
        e = _table(spark, d, "embeddings").orderBy("vec_id").select(F.transform(F.col("embedding").cast("array<double>"), _BYTE[kind][1]).cast("array<float>").alias("vec"))
        v = F.col("vec").cast("array<double>")
        return _files(spark, e, kind).select("id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("q"))


@_df("sc13_npy", f"select {_IDS}, len(embedding) as n, true as near, round(cast(embedding[1] as double) * 100, 0) + 0 as first from embeddings")
def _(spark, d):
    """Half floats: every coordinate within half a unit of the eleven bits that a half has (or 2 ** -25), by a join with the table."""
    e = _table(spark, d, "embeddings").orderBy("vec_id").select(F.col("embedding").alias("vec"))
    exact = _files(spark, e, "fbin").withColumnRenamed("vec", "exact")
    near = F.forall(F.zip_with("vec", "exact", lambda h, x: F.abs(h.cast("double") - x.cast("double")) <= F.greatest(F.abs(x.cast("double")) / 2048, F.lit(2.0**-25))), lambda ok: ok)
    return _files(spark, e, "npy").join(exact, "id").select("id", F.size("vec").cast("long").alias("n"), near.alias("near"), (F.round(F.get("exact", F.lit(0)).cast("double") * 100) + 0).alias("first"))


def _found(spark, d, name: str) -> DataFrame:
    """The results of a search by query, in the order of query ids. They are stored, as an order looks at its rows twice and a search should run once."""
    path = scratch(spark, "found")
    QUERIES[name](spark, d).write.parquet(path)
    return spark.read.parquet(path).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("dist", "key"))).alias("r")).orderBy("qid").select(F.col("r.key").alias("neighbors"), F.col("r.dist").cast("array<float>").alias("distances"))


_TRUTH = "select q.id, n.place, key, round(n.dist, 4) as dist from (select qid, row_number() over (order by qid) - 1 as id from (select distinct qid from pairs where {0}) t) q join (select qid, key, dist, row_number() over (partition by qid order by round(dist, 6), key) - 1 as place from pairs where {0}) n on q.qid = n.qid where {1}"


def _places(back: DataFrame) -> DataFrame:
    each = back.select("id", F.posexplode(F.arrays_zip("neighbors", "distances")).alias("place", "x"))
    return each.select("id", F.col("place").cast("long").alias("place"), F.col("x.neighbors").alias("key"), F.round(F.col("x.distances").cast("double"), 4).alias("dist"))


@_df("sc14_truth", f"with {_PAIRS.format(q='q.vec_id % 100 = 0')} " + _TRUTH.format("true", "n.place < 10"))
def _(spark, d):
    """Ground truth of a search, ten neighbours a query, as files and back."""
    return _places(_files(spark, _found(spark, d, "se02_batch_knn"), "truth"))


@_df("sc15_range_truth", f"with {_PAIRS.format(q='q.vec_id % 100 = 0')} " + _TRUTH.format("dist < 0.7", "true"))
def _(spark, d):
    """Ground truth of a range search, as many neighbours as are within the range."""
    return _places(_files(spark, _found(spark, d, "se14_range_search"), "range_truth"))


@_df("sc16_csr", f"select id, i, round(x, 6) as x from (select id, unnest(range(0, 64)) as i, unnest(VEC[embedding]) as x from (select embedding, {_IDS} from embeddings) t) u where x > 0.1")
def _(spark, d):
    """Coordinates over a tenth as sparse rows."""
    cells = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda c: c["x"].cast("double") > 0.1)
    rows = _table(spark, d, "embeddings").orderBy("vec_id").select(cells.alias("c")).select(F.col("c.i").alias("indices"), F.col("c.x").alias("values"))
    back = _files(spark, rows, "csr").select("id", F.explode(F.arrays_zip("indices", "values")).alias("x"))
    return back.select("id", F.col("x.indices").cast("long").alias("i"), F.round(F.col("x.values").cast("double"), 6).alias("x"))


#: Price and part of a line as 32-bit coordinates.
_XY = {"x": "l_partkey * 200000", "y": "cast(floor(l_extendedprice * 20000) as bigint)"}
_Z = "cast(list_sum(list_transform(range(0, 31), lambda i: (((x // 2) >> i) & 1) * cast(pow(2, 2 * i) as bigint) + (((y // 2) >> i) & 1) * cast(pow(2, 2 * i + 1) as bigint))) as bigint)"


def _map(spark, d) -> str:
    path = scratch(spark, "map")
    lines = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey * 200000L").alias("x"), F.expr("cast(floor(l_extendedprice * 20000) as bigint)").alias("y"))
    tiles.write_map(lines, path)
    return path


def _in_order(stored: DataFrame, key: str) -> DataFrame:
    """The rows of a stored table with ``in_order``: whether a row's key is at least that of the row before it in its file and of all files before."""
    rows = stored.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))  # a row per file
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    apart = files.select("__file", F.coalesce(F.col("lo") >= F.max("hi").over(earlier), F.lit(True)).alias("__apart"))
    # a row's predecessor is at the place before, in the same stretch of a file or at the end of the one before it
    cut = rows.withColumn("__stretch", F.floor(F.col("__row") / 100_000))
    lasts = cut.groupBy("__file", (F.col("__stretch") + 1).alias("__stretch")).agg(F.max(F.struct("__row", F.col(key).alias("k")))["k"].alias("__last"))
    inside = F.lag(key).over(Window.partitionBy("__file", "__stretch").orderBy("__row"))
    checked = cut.join(lasts, ["__file", "__stretch"], "left").withColumn("__before", F.coalesce(inside, "__last")).join(apart, "__file")
    return checked.withColumn("in_order", F.coalesce(F.col("__before") <= F.col(key), F.lit(True)) & F.col("__apart"))


@_df("sk05_sorted_merge", "select vec_id, label, true as in_order from embeddings")
def _(spark, d):
    """Shards of a table merged in key order: ranges of the key are written side by side, and each row is checked to follow the one before."""
    path = scratch(spark, "sorted")
    _table(spark, d, "embeddings").select("vec_id", "label").orderBy("vec_id").write.parquet(path)
    return _in_order(spark.read.parquet(path), "vec_id").select("vec_id", "label", "in_order")


@_df("sk09_z_order", f"select l_orderkey, l_linenumber, {_Z} as zkey, true as in_order from (select l_orderkey, l_linenumber, {_XY['x']} as x, {_XY['y']} as y from lineitem) t")
def _(spark, d):
    """A Z-ordered copy: the key of each row, and whether it is at least that of the row before it in its file and of all files before."""
    rows = _in_order(spark.read.parquet(_map(spark, d)), "zkey")
    return rows.select("l_orderkey", "l_linenumber", "zkey", "in_order")


#: A tile of the map: 32-bit coordinates, ends included.
TILE = (100_000_000, 150_000_000, 400_000_000, 900_000_000)


@_df("mp01_tile_read", f"select l_orderkey, l_linenumber, x, y from (select l_orderkey, l_linenumber, {_XY['x']} as x, {_XY['y']} as y from lineitem) t where x between {TILE[0]} and {TILE[1]} and y between {TILE[2]} and {TILE[3]}")
def _(spark, d):
    """The lines of a tile, from the row groups of the Z-ordered copy that its key intervals meet."""
    return tiles.read_tile(spark, _map(spark, d), *TILE).select("l_orderkey", "l_linenumber", "x", "y")


@_df("sk06_load_log", "select doc_id, lang from documents")
def _(spark, d):
    """Languages as blocks, each loaded twice: the second time its content is known and refused. A load that died before its entry is redone."""
    path = scratch(spark, "log")
    docs = _table(spark, d, "documents").select("doc_id", "lang")
    blocks = [r[0] for r in docs.select("lang").distinct().collect()]  # a block for each language

    def die() -> None:
        raise InterruptedError

    for k, lang in enumerate(blocks):
        rows = docs.where(F.col("lang").eqNullSafe(lang))
        if k == 0:
            try:
                loads.load_block(rows, path, str(lang), die)
            except InterruptedError:
                pass
        if not loads.load_block(rows, path, str(lang)) or loads.load_block(rows, path, str(lang)):
            raise RuntimeError(f"block {lang} is not loaded exactly once")
    return loads.loaded(spark, path, docs.schema)


@_df("or02_mop_up", "select vec_id, label from embeddings")
def _(spark, d):
    """Chunks of a table by label, some of which fail at first, are loaded in passes until none is missing and counts match."""
    path = scratch(spark, "mop")
    e = _table(spark, d, "embeddings").select("vec_id", "label")
    failures: dict = {}

    def chunk(label):
        def rows() -> DataFrame:
            failures[label] = failures.get(label, -1 if label is None else int(label) % 3) - 1
            if failures[label] >= 0:
                raise ConnectionError(f"chunk {label}")
            return e.where(F.col("label").eqNullSafe(label))

        return rows

    left = loads.mop_up(spark, path, {str(r[0]): chunk(r[0]) for r in e.select("label").distinct().collect()})  # a chunk for each label
    if left:
        raise RuntimeError(f"chunks {left} are missing")
    return loads.loaded(spark, path, e.schema)


@_df("or16_bulk_load", "select name, rows from (select 'embeddings' as name, count(*) as rows from embeddings union all select 'labels', count(*) from labels union all select 'orders', count(*) from orders) t")
def _(spark, d):
    """Shards of several tables loaded from disk with a log: block and rows of each entry."""
    path = scratch(spark, "bulk")
    for name in ("embeddings", "labels", "orders"):
        loads.load_block(_table(spark, d, name), path, name)
    return spark.createDataFrame([(x["block"], x["rows"]) for x in loads.log(spark, path)], "name string, rows long")


@_df("or12_patch", "select vec_id, label, round(list_sum(list_transform(VEC[embedding], lambda x: x * x)), 6) as q from embeddings")
def _(spark, d):
    """Vectors of three labels that came as zeros are computed again, and only these labels' partitions are rewritten."""
    path = scratch(spark, "patch")
    e = _table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    bad = (F.col("vec_id") % 7 == 0) & (F.col("label") < 3)
    holed = e.withColumn("ok", F.when(bad, 0).otherwise(1)).withColumn("embedding", F.when(bad, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))
    holed.write.partitionBy("label").parquet(path)
    again = lambda rows: rows.drop("embedding", "ok").join(e.select("vec_id", "embedding"), "vec_id").withColumn("ok", F.lit(1))
    loads.patch(spark, path, "label", "ok = 0", again, f"{path}-staging")
    back = spark.read.parquet(path)
    return back.where("ok = 1").select("vec_id", F.col("label").cast("int").alias("label"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x), 6).alias("q"))


BUCKETS = 16


def bucketed(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a stored table, hashed into buckets by a key and sorted in each: joins and groups on the key need no shuffle."""
    spark = df.sparkSession
    name = f"lumen_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", scratch(spark, "buckets")).saveAsTable(name)
    return spark.table(name)


@_df("jn11_buckets", "select l_orderkey, l_linenumber, o_custkey, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey")
def _(spark, d):
    """Lines and orders bucketed by order: the join goes bucket by bucket, each as one task's merge."""
    lines = bucketed(_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")
    orders = bucketed(_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderpriority")


@_df("or15_staged_join", "select o_orderkey, round(o_totalprice, 2) as price, n from (select l_orderkey, count(*) as n from lineitem group by l_orderkey) l join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'")
def _(spark, d):
    """Keys and values pushed to a staging table, then joined where the other table is."""
    path = scratch(spark, "staging")
    _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).write.parquet(path)
    staged = spark.read.schema("l_orderkey long, n long").parquet(path)
    return staged.join(_table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.round("o_totalprice", 2).alias("price"), "n")


@_df("sc23_size_by_path", "select folder, depth, rows from (select '' as folder, 0 as depth, count(*) as rows from documents union all select 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__'), 1, count(*) from documents group by lang union all select 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') || '/source=' || coalesce(source, '__HIVE_DEFAULT_PARTITION__'), 2, count(*) from documents group by lang, source) t")
def _(spark, d):
    """Sizes by path and depth, from the listing of an export as lines of one byte (and its end) a row: files' bytes, summed at each depth."""
    path = scratch(spark, "listing")
    docs = _table(spark, d, "documents").select(F.lit("x").alias("value"), "lang", "source")
    docs.write.option("lineSep", "\n").partitionBy("lang", "source").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path).select("path", "length")
    parts = files.select(F.regexp_extract("path", "(lang=[^/]*)/(source=[^/]*)/", 1).alias("a"), F.regexp_extract("path", "(lang=[^/]*)/(source=[^/]*)/", 2).alias("b"), "length")
    each = parts.select(F.explode(F.array(F.struct(F.lit("").alias("folder"), F.lit(0).alias("depth")), F.struct(F.col("a").alias("folder"), F.lit(1).alias("depth")), F.struct(F.concat_ws("/", "a", "b").alias("folder"), F.lit(2).alias("depth")))).alias("p"), "length")
    return each.groupBy("p.folder", "p.depth").agg(F.expr("sum(length) div 2").alias("rows"))


@_df("sc18_json_lines", "select doc_id, lang, 'a' || chr(65533) || 'b' as broken from documents")
def _(spark, d):
    """JSON lines with a byte that is no UTF-8 in each: it becomes the replacement character, and lines end at a line feed alone."""
    path = scratch(spark, "json")
    line = F.to_json(F.struct("doc_id", "lang", F.lit("a\rb").alias("cr")))
    body = F.concat(F.encode(F.substring_index(line, "}", 1), "UTF-8"), F.encode(F.lit(',"broken":"a'), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit('b"}'), "UTF-8"))
    rows = _table(spark, d, "documents").select("doc_id", "lang").select(body.alias("raw"))
    # Spark's text sink writes strings as they are, bytes that are no UTF-8 too
    rows.select(F.col("raw").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.from_json(F.make_valid_utf8("value"), "doc_id long, lang string, broken string").alias("r")).select("r.*")


@_df("or13_task_list", "select page_id, task from (select page_id, case when page_id % 10 = 3 then 429 when page_id % 10 = 7 or html is null then 500 else 200 end as code, url from pages) t join (select 200 as c, cast(null as varchar) as task union all select 429, 'later' union all select 500, 'again') k on code = c where task is not null and url is not null")
def _(spark, d):
    """What is to be fetched again, and how, by the status code that a survey saw."""
    code = F.when(F.col("page_id") % 10 == 3, 429).when((F.col("page_id") % 10 == 7) | F.col("html").isNull(), 500).otherwise(200)
    task = reduce(lambda c, x: c.when(code == x[0], x[1]), [(500, "again")], F.when(code == 429, "later"))
    return _table(spark, d, "pages").where("url is not null").select("page_id", task.alias("task")).where("task is not null")

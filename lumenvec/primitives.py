"""More queries of the catalogue: array and string primitives on their own, models kept in tables, aggregate states that are fitted and applied."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenvec.catalogue import LOOKUP_ROWS, _DIALECTS, _df, _sql, _table
from lumenvec.evaluation import _ROT, DIM
from lumenvec.functions import text as tx
from lumenvec.functions import vec
from lumenvec.operators import images, ranks

_DIALECTS |= {
    "HAS": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
    "JOINED": ("array_join({0}, '{1}')", "array_to_string({0}, '{1}')"),
    "ARR": ("array({0})", "list_value({0})"),
}

# Joins
_sql("jn06_pool_by_queries", "select q.vec_id as qid, s.label, count(*) as n from embeddings s cross join (select vec_id from embeddings where vec_id % 100 = 0) q where s.vec_id <> q.vec_id group by q.vec_id, s.label")

# Arrays
_sql("ar03_sum", "select vec_id, round(SUM[VEC[embedding]], 6) as s from embeddings")
_sql("ar10_position", "select vec_id, cast(PLACE[embedding;AT[embedding;7]] as int) as at, AT[embedding;64] as final from embeddings")
_sql("ar11_has", "select doc_id, HAS[SPLIT[lower(text); ];'the'] as has from documents where text is not null")
_sql("ar12_range", "select o_orderkey, LEN[SERIES[1;o_orderkey % 9 + 1]] as n, MAXOF[SERIES[3;o_orderkey % 9 + 3]] as top from orders")
_sql("ar14_join", "select page_id, JOINED[SPLIT[url;/];|] as u from pages")
_sql("ar15_length", "select doc_id, LEN[SPLIT[text; ]] as n from documents where text is not null")
_sql("ar16_cast", "select vec_id, AT[VEC[embedding];1] * 2 as a from embeddings")
_sql("ar18_literal", "select vec_id, round(DOT[VEC[embedding];ARR[5e-1, 25e-2, 125e-3];3], 6) as p from embeddings")
_sql("ar19_enumerated", "select vec_id, " + ", ".join(f"AT[embedding;{i}] as x{i}" for i in range(1, 17)) + " from embeddings")


@_df("ar20_map_subscript", "select event_id, JSON[props;k] as k from events")
def _(spark, d):
    return _table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].alias("k"))


# Strings
_sql("st03_trim_replace", "select doc_id, trim(replace(text, '.', ' ')) as t from documents")
_sql("st04_split", "select page_id, AT[SPLIT[url;/];3] as host, LEN[SPLIT[url;/]] as n from pages where url like '%://%/%'")
_sql("st07_sharded_path", "select page_id, concat(substr(md5(url), 1, 3), '/', substr(md5(url), 4, 3), '/', md5(url), '.jpg') as path from pages")
_sql("st09_portable_hash", "select vec_id, HASH[vec_id] as h, HASH[concat('seed|', vec_id)] as seeded from embeddings")


@_df("st12_tokens", r"select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as n from documents where text is not null")
def _(spark, d):
    return _table(spark, d, "documents").where("text is not null").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n"))


@_df("st13_tag_list", "select page_id, array_to_string(list_filter(list_transform(string_split(concat(replace(url, '/', ','), ',a%20b,,'), ','), lambda x: url_decode(x)), lambda x: x <> ''), '|') as tags from pages")
def _(spark, d):
    """A comma-separated list of url-encoded tags, without empty ones."""
    tags = F.split(F.concat(F.translate("url", "/", ","), F.lit(",a%20b,,")), ",")
    return _table(spark, d, "pages").select("page_id", F.array_join(F.filter(F.transform(tags, F.try_url_decode), lambda x: x != ""), "|").alias("tags"))


@_df("st15_dates", "select event_id, cast(cast(ts as date) as varchar) as day, try_cast(event_type as timestamp) is null as bad, cast(cast(make_timestamp(event_id * 86400 * 1000000) as date) as varchar) as epoch_day from events")
def _(spark, d):
    """A timestamp's day, text that is no timestamp, and seconds since the epoch."""
    epoch = F.timestamp_seconds(F.col("event_id") * 86400)
    text = lambda c: F.regexp_replace(F.to_date(c).cast("string"), r"^\+", "")  # noqa: E731  (Spark puts a plus before years of five digits)
    return _table(spark, d, "events").select("event_id", text(F.col("ts")).alias("day"), F.try_to_timestamp("event_type").isNull().alias("bad"), text(epoch).alias("epoch_day"))


# Vectors and rasters
@_df("ve12_standardised", f"with {_ROT} select round(avg(x), 6) as mean, round(stddev_pop(x), 6) as sd, count(*) as n from (select unnest(r) * 8 as x from rot) t")
def _(spark, d):
    """Coordinates after sign flips and rotation, times the root of the dimension: near mean 0 and deviation 1 for unit vectors."""
    x = _table(spark, d, "embeddings").select(F.explode(vec.hadamard_rotate(F.col("embedding"), DIM)).alias("x")).select((F.col("x") * 8).alias("x"))
    return x.agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"), F.count("*").alias("n"))


@_df("mp12_nearest", f"select vec_id, array_to_string(list_transform({[r * 8 + c + 1 for r in (1, 3, 5, 7) for c in (1, 3, 5, 7)]}, lambda i: repeat(printf('%02X', cast(trunc(greatest(-1e0, least(1e0, cast(embedding[i] as double))) * 127 + 128) as integer)), 3)), '') as pixels from embeddings")
def _(spark, d):
    """Every vector's bytes as a raster of 8 by 8 in grey: the pixel at the middle of each of 4 by 4."""
    byte = F.transform(vec.doubles(F.col("embedding")), lambda x: F.repeat(F.lpad(F.hex((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 127 + 128).cast("int")), 2, "0"), F.lit(3)))
    return _table(spark, d, "embeddings").select("vec_id", F.hex(images.shrink_nearest(F.unhex(F.array_join(byte, "")), 8, 4)).alias("pixels"))


# Models
_WEIGHT = "(((i * c) % 11 - 5) / 4e0)"
_MODEL = f"w as (select c, i, {_WEIGHT} as w from (select EACH[SERIES[1;9]] as c) a cross join (select EACH[SERIES[1;64]] as i) b)"
_LONG = "x as (select vec_id, i, cast(AT[embedding;i] as double) as x from embeddings cross join (select EACH[SERIES[1;64]] as i) s)"
#: A model of nine classes as a table of weights, joined and not spliced into the text.
_sql("ml04_topics", f"with {_MODEL}, {_LONG}, z as (select vec_id, c, round(sum(x * w), 9) as z from x join w on x.i = w.i group by vec_id, c), r as (select *, row_number() over (partition by vec_id order by z desc, c) as rn from z) select vec_id, c as topic, round(z, 6) as z from r where rn = 1")
_sql("ud06_weight_table", f"with w as (select i, ((i % 5) - 2) / 2e0 as w from (select EACH[SERIES[1;64]] as i) s), {_LONG} select vec_id, round(1 / (1 + exp(-(sum(x * w) + 0.1))), 6) as p from x join w on x.i = w.i group by vec_id")
_sql("ml03_softmax", "with z as (select vec_id, AT[VEC[embedding];1] as a, AT[VEC[embedding];2] as b, AT[VEC[embedding];3] as c from embeddings), m as (select *, greatest(a, b, c) as m from z) select vec_id, round(exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) as pa, round(exp(b - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) as pb from m")
_sql("ud03_table_functions", "select p_partkey, n, word from (select p_partkey, n, EACH[SPLIT[p_name; ]] as word from (select p_partkey, p_name, EACH[SERIES[1;cast(p_size % 3 as int) + 1]] as n from part) a) t")


_SPLIT = "e as (select vec_id, label, cast(embedding as double[]) as v, row_number() over (partition by label order by HASH[vec_id], vec_id) <= ceil(0.75e0 * count(*) over (partition by label)) as train from embeddings)"


@_df("ml09_macro_f1", f"with {_SPLIT}, m as (select label, list(x order by i) as c from (select label, i, avg(x) as x from (select label, unnest(range(1, 65)) as i, unnest(v) as x from e where train) t group by label, i) u group by label), s as (select e.vec_id, e.label as y, m.label as guess, row_number() over (partition by e.vec_id order by round(list_cosine_distance(e.v, m.c), 12), m.label) as rn from e, m where not e.train), g as (select y, guess, count(*) as n from s where rn = 1 group by y, guess), k as (select distinct label as c from embeddings), f as (select c, coalesce(sum(n) filter (y = c and guess = c), 0) as hit, coalesce(sum(n) filter (guess = c), 0) as said, coalesce(sum(n) filter (y = c), 0) as is_ from k cross join g group by c) select c as label, cast(hit as bigint) as hit, cast(said as bigint) as said, cast(is_ as bigint) as real, round(case when said + is_ = 0 then 0 else 2e0 * hit / (said + is_) end, 6) as f1, round(avg(case when said + is_ = 0 then 0 else 2e0 * hit / (said + is_) end) over (), 6) as macro_f1 from f")
def _(spark, d):
    """Per-class and macro F1 of the nearest class mean, on the quarter of a split that is stratified by class."""
    e = _table(spark, d, "embeddings").select("vec_id", "label", vec.doubles(F.col("embedding")).alias("v"), vec.hash_int(F.col("vec_id")).alias("h"))
    numbered = ranks.row_numbers(e, ["label", "h", "vec_id"])
    firsts = numbered.groupBy("label").agg(F.min("rn").alias("first"), F.count("*").alias("n"))  # a row per class
    e = numbered.join(firsts, "label").withColumn("train", F.col("rn") - F.col("first") + 1 <= F.ceil(0.75 * F.col("n")))
    means = e.where("train").select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    c = means.groupBy(F.col("label").alias("guess")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("c"))
    near = e.where("not train").crossJoin(F.broadcast(c) if c.count() <= LOOKUP_ROWS else c).select("vec_id", "label", "guess", F.round(vec.cosine_distance(F.col("v"), F.col("c")), 12).alias("dist"))
    best = near.groupBy("vec_id", "label").agg(F.min(F.struct("dist", "guess"))["guess"].alias("guess")).groupBy("label", "guess").agg(F.count("*").alias("n"))
    sides = best.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(0).alias("said")), F.struct(F.col("guess").alias("c"), F.lit(1).alias("said")))).alias("s"), "n", (F.col("label") == F.col("guess")).alias("hit"))
    known = e.select(F.col("label").alias("c")).distinct()
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")
    f = known.join(sides.select("s.*", "n", "hit"), "c", "left").groupBy(F.col("c").alias("label")).agg(count((F.col("said") == 1) & F.col("hit")).alias("hit"), count(F.col("said") == 1).alias("said"), count(F.col("said") == 0).alias("real"))
    f1 = F.when(F.col("said") + F.col("real") == 0, 0.0).otherwise(2.0 * F.col("hit") / (F.col("said") + F.col("real")))
    return f.withColumn("f", f1).crossJoin(F.broadcast(f.agg(F.round(F.avg(f1), 6).alias("macro_f1")))).select("label", "hit", "said", "real", F.round("f", 6).alias("f1"), "macro_f1")

"""Queries over sources and sinks: each writes its whole table to a scratch folder and reads it back.

The folder lies in ``spark.checkpoint.dir``, which all executors share; in a local session without one, as in tests, in a temporary folder.
A sink replaces what an earlier run left, so that a repeated job ends in the same state.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenvec.catalogue import _df, _table
from lumenvec.plans import sinks
from lumenvec.sources import binary


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for each call."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lumenvec-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Sources
@_df("sc05_text_lines", "select line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents where text is not null) t group by line")
def _(spark, d):
    """Texts as lines of compressed files, read by a glob; a line ends at a line feed alone."""
    path = scratch(spark, "lines")
    _table(spark, d, "documents").where("text is not null").select(F.col("text").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)
    return spark.read.option("lineSep", "\n").text(f"{path}/*.gz").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@_df("sc07_tsv_all_strings", "select c_custkey, c_nationkey, round(c_acctbal, 2) as bal, c_name from customer")
def _(spark, d):
    """Tab-separated columns come as strings and are cast with care."""
    path = scratch(spark, "tsv")
    _table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("sep", "\t").csv(path)
    raw = spark.read.option("sep", "\t").schema("c1 string, c2 string, c3 string, c4 string").csv(path)
    return raw.select(F.expr("try_cast(c1 as bigint)").alias("c_custkey"), F.expr("coalesce(try_cast(c3 as int), 0)").alias("c_nationkey"), F.round(F.expr("try_cast(c4 as double)"), 2).alias("bal"), F.col("c2").alias("c_name"))


@_df("sc21_headed_csv", "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F'")
def _(spark, d):
    path = scratch(spark, "csv")
    _table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("o_orderkey long, o_orderstatus string, o_orderpriority string").csv(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")


@_df("sc06_binary_files", "select r_name as name, length(r_name) as n from region")
def _(spark, d):
    """Whole files as rows: one file for each region, its folder's name from the path and its bytes' number."""
    path = scratch(spark, "blobs")
    _table(spark, d, "region").select(F.col("r_name").alias("value"), F.col("r_name").alias("folder")).repartition("folder").write.option("lineSep", "|").partitionBy("folder").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.url_decode(F.regexp_extract("path", "folder=([^/]*)/", 1)).alias("name"), (F.length("content") - 1).cast("long").alias("n"))




#: Bytes of text that are encoded at once at about most; a longer text is alone.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch of (doc_id, text) in slices of about so many bytes of text, a row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (most or PIECE_BYTES), "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _through(spark, d, encode, decode):
    """Documents as bytes of an interchange format, piece by piece, and back; a task holds the bytes of one piece."""
    shape = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                for pdf in decode(encode(piece.to_pandas())):
                    yield pa.RecordBatch.from_pandas(pdf[["doc_id", "text"]], shape, preserve_index=False)

    return _table(spark, d, "documents").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")


@_df("sc19_row_binary", "select doc_id, coalesce(text, '') as text from documents")
def _(spark, d):
    """Rows as a 64-bit number and a string with its length before it, seven bits a byte."""
    return _through(spark, d, lambda pdf: b"".join(int(i).to_bytes(8, "little", signed=True) + binary.varint(len(t)) + t for i, t in zip(pdf["doc_id"], (x.encode() if x is not None else b"" for x in pdf["text"]))), binary.parse_row_binary)


@_df("sc20_arrow_stream", "select doc_id, text from documents")
def _(spark, d):
    """Arrow IPC streams, whose small batches are put together to batches of up to 32,768 rows."""
    def encode(pdf):
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(pdf[["doc_id", "text"]], preserve_index=False).cast(pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table, max_chunksize=100)
        return sink.getvalue().to_pybytes()

    return _through(spark, d, encode, binary.parse_arrow_stream)


# Sinks
@_df("sk01_append_named", "select o_orderkey, o_custkey from orders union all select o_orderkey, o_custkey from orders")
def _(spark, d):
    path = scratch(spark, "append")
    for _ in range(2):
        sinks.append_named(_table(spark, d, "orders"), path, ["o_orderkey", "o_custkey"])
    return spark.read.schema("o_orderkey long, o_custkey long").parquet(path)


@_df("sk02_create_as_select", "select c_nationkey, count(*) as n from customer group by c_nationkey")
def _(spark, d):
    name = f"lumen_{uuid.uuid4().hex}"
    path = scratch(spark, "table")
    made = _table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    made.write.mode("overwrite").option("path", path).saveAsTable(name)
    return spark.table(name).select("c_nationkey", "n")


@_df("sk03_partitioned_export", "select o_orderkey % 16 as bucket, count(*) as n from orders group by 1")
def _(spark, d):
    path = scratch(spark, "parts")
    o = _table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 16).alias("bucket"))
    o.repartition("bucket").write.partitionBy("bucket").parquet(path)
    return spark.read.schema("o_orderkey long, bucket long").parquet(path).groupBy("bucket").agg(F.count("*").alias("n"))


@_df("sk06_chunk_once", "select doc_id, lang from documents where lang is not null")
def _(spark, d):
    """A chunk that is loaded again replaces itself."""
    path = scratch(spark, "chunks")
    docs = _table(spark, d, "documents").where("lang is not null").select("doc_id", "lang")
    for _ in range(2):
        sinks.write_chunk(docs, path, "lang")
    return spark.read.schema("doc_id long, lang string").parquet(path)


@_df("sk07_delete", "select p_partkey, p_size from part where not coalesce(p_size < 10, false)")
def _(spark, d):
    path = scratch(spark, "delete")
    _table(spark, d, "part").select("p_partkey", "p_size").write.parquet(path)
    sinks.delete_where(spark, path, f"{path}-kept", "p_size < 10")
    return spark.read.schema("p_partkey long, p_size int").parquet(f"{path}-kept")


@_df("sk04_outfile", "select page_id, md5(url) as h from pages")
def _(spark, d):
    """The result of a query as Parquet files."""
    path = scratch(spark, "outfile")
    _table(spark, d, "pages").select("page_id", F.md5("url").alias("h")).write.parquet(path)
    return spark.read.schema("page_id long, h string").parquet(path)


@_df("sk08_add_column", "select p_partkey, cast(p_size as bigint) as p_size, p_size * 3 as triple from part")
def _(spark, d):
    """A column added to a stored table and another's type widened: a new version of the table beside the old one."""
    path = scratch(spark, "columns")
    _table(spark, d, "part").select("p_partkey", "p_size").write.parquet(f"{path}/version=1")
    sinks.alter(spark, f"{path}/version=1", f"{path}/version=2", {"triple": "p_size * 3", "p_size": "cast(p_size as bigint)"})
    return spark.read.schema("p_partkey long, p_size long, triple int").parquet(f"{path}/version=2")


@_df("sk10_collapse", "select l_partkey, cast(sum(l_linenumber) as bigint) as n, cast(2 * count(*) as bigint) as loads from lineitem group by l_partkey")
def _(spark, d):
    """A summing table takes two loads as they come and is collapsed to a row for each key afterwards."""
    path = scratch(spark, "summing")
    part = _table(spark, d, "lineitem").select("l_partkey", F.col("l_linenumber").cast("long").alias("n"), F.lit(1).cast("long").alias("loads"))
    sinks.append_named(part, f"{path}/open", ["l_partkey", "n", "loads"])
    sinks.append_named(part.withColumn("n", F.lit(0).cast("long")), f"{path}/open", ["l_partkey", "n", "loads"])
    sinks.collapse(spark, f"{path}/open", f"{path}/collapsed", ["l_partkey"], ["n", "loads"])
    return spark.read.schema("l_partkey long, n long, loads long").parquet(f"{path}/collapsed")


@_df("sk11_resume", "select doc_id, quality from labels")
def _(spark, d):
    """Results that are there already are not computed again: an anti join on their key, then an append."""
    path = scratch(spark, "resume")
    rows = _table(spark, d, "labels").select("doc_id", "quality")
    rows.where("quality = 1").write.parquet(path)
    done = spark.read.schema("doc_id long, quality int").parquet(path)
    rows.join(done.select("doc_id"), "doc_id", "left_anti").write.mode("append").parquet(path)
    return spark.read.schema("doc_id long, quality int").parquet(path)

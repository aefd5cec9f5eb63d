"""Sharding by fixed virtual slots: records hash into slots, bytes are summed per slot, and a versioned map deals slots to shards."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenvec.llm.common import materialize, scratch_path

SLOTS = 4096
#: Hash parts of a slot within which rows are numbered; slots * CELLS bounds the table of counts.
CELLS = 16


def slot_rows(docs: DataFrame, shards: int, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot, cell): equal texts share a slot, unless they are more than half of a shard's fair share.

    Such groups, fewer than 2 * shards of them, are dealt over all slots by the place at which a row was written, whatever ids its rows
    share; cells are dealt by that place too. Size is the text's UTF-8 bytes plus 1.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    narrow = materialize(narrow, "sizes")
    groups = narrow.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    hot = groups.join(F.broadcast(total), F.col("bytes") * 2 * shards > F.col("total")).select("digest", F.lit(True).alias("hot"))
    key = F.when(F.col("hot"), F.xxhash64("digest", "row")).otherwise(F.xxhash64("digest"))
    return narrow.join(F.broadcast(hot), "digest", "left").select("doc_id", "size", "text_crc32", F.pmod(key, F.lit(slots)).cast("int").alias("vslot"), F.pmod(F.xxhash64("row", F.lit(7)), F.lit(CELLS)).cast("int").alias("cell"))


def plan_map(loads: dict[int, int], shards: int, slots: int = SLOTS, old: dict[int, int] | None = None, slack: float = 0.001) -> dict[int, int]:
    """Slot to shard. Without ``old``: longest processing time first. With it: an edit that moves few slots.

    An edit keeps every slot whose shard still exists, deals the others to the lightest shards, then moves slots from the heaviest to
    the lightest shard, the largest that helps first, until loads are within ``slack`` of the mean or no move helps.
    """
    weight = {v: loads.get(v, 0) for v in range(slots)}
    load = dict.fromkeys(range(shards), 0)
    place = {v: s for v, s in (old or {}).items() if s < shards and v < slots}
    for v, s in place.items():
        load[s] += weight[v]
    heap = [(n, s) for s, n in load.items()]
    heapq.heapify(heap)
    for v in sorted(set(range(slots)) - set(place), key=lambda v: (-weight[v], v)):
        n, s = heapq.heappop(heap)
        place[v] = s
        heapq.heappush(heap, (n + weight[v], s))
    if old:
        load = dict.fromkeys(range(shards), 0)
        for v, s in place.items():
            load[s] += weight[v]
        mean = sum(load.values()) / shards
        for _ in range(2 * slots):
            high, low = max(load, key=load.get), min(load, key=load.get)
            gap = load[high] - load[low]
            fits = [v for v, s in place.items() if s == high and 0 < weight[v] < gap and weight[v] <= max(load[high] - mean, mean - load[low])]
            if load[high] <= (1 + slack) * mean and load[low] >= (1 - slack) * mean or not fits:
                break
            v = max(fits, key=lambda v: (weight[v], -v))
            place[v] = low
            load[high] -= weight[v]
            load[low] += weight[v]
    return place


def even_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """The map that a new store starts with, before any bytes are known: slots dealt in turn."""
    return {v: v % shards for v in range(slots)}


def map_table(spark: SparkSession, place: dict[int, int], version: int) -> DataFrame:
    """A slot-to-shard map as a table (version, vslot, shard); it has one row per slot."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"vslot": v, "shard": s} for v, s in sorted(place.items())])), "array<struct<vslot int, shard int>>")).alias("x")).select(F.lit(version).alias("version"), "x.vslot", "x.shard")


def slot_loads(rows: DataFrame, weigh: str = "size") -> dict[int, int]:
    """Bytes per slot; at most as many rows as there are slots reach the driver."""
    return {r.vslot: r.n for r in rows.groupBy("vslot").agg(F.sum(weigh).alias("n")).collect()}


def write_map(spark: SparkSession, place: dict[int, int], version: int, path: str) -> None:
    """Store a version of the map beside the earlier ones; a version that is there is replaced."""
    map_table(spark, place, version).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """The latest version of a stored map, or the one that is asked for."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return version, {r.vslot: r.shard for r in table.where(F.col("version") == version).collect()}


def rebalance(spark: SparkSession, rows: DataFrame, path: str, shards: int, slots: int = SLOTS) -> tuple[int, dict[int, int]]:
    """Edit the stored map for today's bytes and number of shards, and store it as the next version."""
    version, old = read_map(spark, path)
    place = plan_map(slot_loads(rows), shards, slots, old)
    write_map(spark, place, version + 1, path)
    return version + 1, place


def temporary_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> str:
    """The path of a store whose first version is ``even_map``, in the shared folder until the driver's Python ends."""
    path = scratch_path(spark, "slot-map")
    write_map(spark, even_map(shards, slots), 1, path)
    return path


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None, **cols) -> DataFrame:
    """One row per row of ``docs``: (doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version).

    The law is ``bytes``: slots go to shards so that the sums of sizes are near equal. ``slot`` numbers the rows of a shard from 0 without
    gaps, by virtual slot, then cell, then doc_id (rows that are equal in all are interchangeable); ``vslot`` is the virtual slot and
    ``grown_shard`` is null. With ``map_path`` the map stored there is edited and the next version stored, else it is version 1 of its own.

    Equal texts stay together up to half of a shard's fair share; larger groups are dealt over all slots by row, so that shards are near
    equal also where the rows of such a group share an id or have none; which of them goes where depends on the partitions. Null texts have
    size 1 and the CRC of no bytes. Null ids are like any other. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = materialize(slot_rows(docs, shards, slots, **cols), "slots")
    if map_path:
        version, place = rebalance(spark, rows, map_path, shards, slots)
    else:
        version, place = 1, plan_map(slot_loads(rows), shards, slots)
    shard_of = map_table(spark, place, version)
    cells = rows.groupBy("vslot", "cell").agg(F.count("*").alias("n")).join(F.broadcast(shard_of), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("vslot", "cell").orderBy("doc_id", "size", "text_crc32")
    out = rows.withColumn("rn", F.row_number().over(inside)).join(F.broadcast(cells), ["vslot", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))

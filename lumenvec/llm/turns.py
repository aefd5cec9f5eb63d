"""The order of messages in conversations, found by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm.common import materialize, maybe_broadcast


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos): rows by conversation, turn, role and text (nulls first), dealt over tasks by ranges of that order.

    ``pos`` grows along it. Equal rows may be apart, and a conversation may span tasks, so none is too large for one.
    """
    keys = ["conv_id", "turn", "role", "text"]
    numbered = turns.select(*keys).withColumn("__row", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(*keys, "__row").sortWithinPartitions(*keys, "__row")
    return ranged.select(*keys, F.monotonically_increasing_id().alias("pos"))


def numbered_long(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame, int]:
    """Of rows ``in_order`` in a written table: (long, offsets, number of long conversations).

    long: (__conv, total) of conversations of over ``most`` messages or in several tasks. offsets: (__c, __segment, __first, __before), for
    each task's stretch of such a conversation the place of its first message and the messages before it; a row for each task it spans.
    """
    stretches = rows.groupBy(F.col("conv_id").alias("__conv"), F.shiftright("pos", 33).alias("__segment")).agg(F.count("*").alias("n"), F.min("pos").alias("__first"))
    stretches = materialize(stretches, "stretches")
    long = materialize(stretches.groupBy("__conv").agg(F.sum("n").alias("total"), F.count("*").alias("parts")).where((F.col("total") > most) | (F.col("parts") > 1)).select("__conv", "total"), "long")
    count = long.count()
    earlier = Window.partitionBy("__conv").orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    mine = stretches.join(maybe_broadcast(long.withColumnRenamed("__conv", "__l"), count), F.col("__conv").eqNullSafe(F.col("__l")), "left_semi")
    offsets = mine.select(F.col("__conv").alias("__c"), "__segment", "__first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    return long, offsets, count

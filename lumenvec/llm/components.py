"""Connected components of an edge table: union-find inside each partition, then star rounds between partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import drop_scratch, hot_keys, join_hot, materialize


class UnionFind:
    """Sets of ids under their least member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x], x = root, y
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Edges that a task joins in memory before it gives out their stars and forgets them.
LOCAL_EDGES = 500_000


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets, seen = UnionFind(), 0

    def stars() -> pd.DataFrame:
        nodes = list(sets.up)
        return pd.DataFrame({"a": nodes, "b": [sets.find(x) for x in nodes]}, dtype="int64")

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            sets.union(a, b)
        seen += len(pdf)
        if seen >= LOCAL_EDGES:
            yield stars()
            sets, seen = UnionFind(), 0
    yield stars()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) to (node, component): component is the least node that can be reached.

    Only nodes other than their component's least one are returned. Edges are first contracted by union-find within each partition.
    Then large-star and small-star rounds run until no parent has a parent; each round is a written table, so lineage stays short. Nodes
    with over a thousandth of a round's rows, such as the head of a large group, have their least neighbour broadcast, so that their
    rows stay where they are.
    Null ids and loops are ignored; repeated edges count once; an empty table gives an empty one.
    """
    tidy = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a is not null and b is not null and a > b")
    now = materialize(tidy.mapInPandas(_local, "a long, b long").distinct(), "edges")
    for _ in range(most_rounds):
        if now.select("b").distinct().join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        rows = now.count()
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        star = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("c"))
        large = join_hot(both, star.drop("c"), ["a"], hot_keys(star, 2 * rows)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = materialize(large, "stars")
        star = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = join_hot(large, star.drop("c"), ["a"], hot_keys(star, large.count())).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        new = materialize(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a > b").distinct().mapInPandas(_local, "a long, b long").distinct(), "edges")
        drop_scratch(now, large)
        now = new
    raise RuntimeError("components did not settle")

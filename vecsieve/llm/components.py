"""Connected components by contraction: hook to the smallest neighbour, jump pointers, relabel edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Cuts


def _flatten(cuts: Cuts, parent: DataFrame) -> DataFrame:
    """A forest of (a, p), p < a, with every p a root."""
    while True:
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        after = cuts.cut(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        done = after.filter("moved").isEmpty()
        parent = after.select("a", "p")
        if done:
            return parent


def components(cuts: Cuts, edges: DataFrame) -> DataFrame:
    """``(uid, root)`` for the ends of edges (a, b) that are not the least of their component."""
    maps: list[DataFrame] = []
    e = cuts.cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not e.isEmpty():
        parent = _flatten(cuts, cuts.cut(e.groupBy("a").agg(F.min("b").alias("p"))))
        maps.append(parent)
        e = e.join(parent, "a").withColumn("a", F.col("p")).drop("p")
        e = e.join(parent.select(F.col("a").alias("b"), "p"), "b", "left").withColumn("b", F.coalesce("p", "b")).drop("p")
        e = cuts.cut(e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not maps:
        return e.select(F.col("a").alias("uid"), F.col("b").alias("root"))
    out = maps[0].select(F.col("a").alias("uid"), F.col("p").alias("root"))
    for later in maps[1:]:
        moved = out.join(later.select(F.col("a").alias("root"), "p"), "root", "left").select("uid", F.coalesce("p", "root").alias("root"))
        out = cuts.cut(moved.unionByName(later.select(F.col("a").alias("uid"), F.col("p").alias("root"))))
    return out

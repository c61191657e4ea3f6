"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets fill up by weight, limited by what each source can give. Equal blocks of words
are seats: the sources get theirs by highest quotients, then each source's seats go down
a tree of shards, ``fan`` at a time, by the same rule on the words that each shard holds.
In a leaf the documents stand in seeded order, and their words in blocks; the leaf's quota
takes every block as often as it goes, and what remains in seeded order from the first on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import WORD, Cuts


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(rows: DataFrame, group: list[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: the group's ``seats`` go to its rows by the highest weight / (2 k + 1).

    Seats that the divisor method is sure to give are given at once; only those between
    its lower and upper bound compete by quotient. Ties go to the smaller key.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, n = F.sum(weight).over(w), F.count(F.lit(1)).over(w)
    t = rows.withColumn("_w", total).withColumn("_n", n)
    share = lambda q: F.when(F.col("_w") > 0, F.floor(F.greatest(F.lit(0.0), q) * F.col(weight) / F.col("_w") + 0.5)).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("_low", share(F.col(seats) - F.col("_n") / 2)).withColumn("_high", share(F.col(seats) + F.col("_n") / 2))
    t = t.withColumn("_rest", F.col(seats) - F.sum("_low").over(w))
    more = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumn("_k", F.explode_outer(more))
    quotient = F.when(F.col("_k").isNotNull(), F.col(weight) / (2 * F.col("_k") + 1)).otherwise(F.lit(-1.0))
    place = F.row_number().over(w.orderBy(F.col("_q").desc(), F.col(key).asc_nulls_last(), F.col("_k")))
    t = t.withColumn("_q", quotient).withColumn("_place", place)
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_place") <= F.col("_rest")), 1).otherwise(0))
    keep = [c for c in rows.columns if c not in (seats, out)]
    return t.groupBy(*keep).agg((F.max("_low") + won).cast("long").alias(out))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``(source, source_size, target)``: shares of all words by weight, none above ``most`` times its source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", pick).withColumn("limit", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("_ratio", F.col("limit") / F.col("weight"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / open_weight)
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return s.withColumn("target", target).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 32, seed: int = 17, leaf_docs: int = 1024, fan: int = 16) -> DataFrame:
    """Words to take from each document so that sources come near their target shares.

    One row per input row: id, source, ``size``, ``source_size``, ``target`` (of its source),
    ``taken``. Sources in order of code points, null last, weigh 1, 2, 3 and so on again; no
    source's target exceeds ``most`` times its size, nor a document's ``taken`` that of its
    own. A null text has size 0; documents without words get 0; texts of any length are counted
    whole; rows that repeat an id are told apart by their texts, and share a shard if these are
    equal too; a null id is an id; an empty table gives an empty result; other columns are not
    read. Reruns agree: order comes from a seeded hash. Words are counted once. The table of
    sources is gathered in one task, that of documents never.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark"))
    base = Cuts(docs.sparkSession).cut(base)
    count = base.count()
    depth = max(0, math.ceil(math.log(max(1, count / leaf_docs), fan)))
    dealt = F.pmod(F.xxhash64(F.lit(seed), "id", "mark"), F.lit(fan**depth))
    base = base.withColumn("leaf", dealt)
    held = base.groupBy("source", "leaf").agg(F.sum("size").alias("words"))
    targets = source_targets(base, weights, most)
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long")
    quota = apportion(targets.withColumn("_seats", seats), [], "source", "target", "_seats", "quota")
    known = F.col("source").eqNullSafe(F.col("_source"))
    level = quota.select("source", F.lit(0).cast("long").alias("shard"), "quota")
    for d in range(1, depth + 1):
        step = fan ** (depth - d)
        parts = held.groupBy("source", F.floor(F.col("leaf") / step).alias("part")).agg(F.sum("words").alias("words"))
        up = level.select(F.col("source").alias("_source"), F.col("shard"), F.col("quota").alias("_seats"))
        below = parts.withColumn("_up", F.floor(F.col("part") / fan)).join(up, known & (F.col("_up") == F.col("shard"))).drop("_source", "_up")
        level = apportion(below, ["source", "shard"], "part", "words", "_seats", "quota").select("source", F.col("part").alias("shard"), "quota")
    leaf = held.join(level.select(F.col("source").alias("_source"), F.col("shard").alias("leaf_"), "quota"), known & (F.col("leaf") == F.col("leaf_"))).drop("_source", "leaf_")
    goal = targets.select(F.col("source").alias("_source"), "source_size", "target")
    most_words = F.col("words") * most
    # a source at its limit is taken whole: its seats, rounded in each shard, would miss it
    due = F.when(F.col("target") >= most * F.col("source_size"), most_words).otherwise(F.least(F.col("quota") * block_words, most_words))
    leaf = leaf.join(goal, known).withColumn("due", due).drop("_source", "quota")
    leaf = leaf.withColumnRenamed("source", "_source").withColumnRenamed("leaf", "leaf_")
    out = base.join(leaf, known & (F.col("leaf") == F.col("leaf_"))).drop("_source", "leaf_")
    order = Window.partitionBy("source", "leaf").orderBy(F.md5(F.concat_ws("-", F.lit(seed), "id")), "id", "size", "mark")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("words") > 0, F.floor(F.col("due") / F.col("words"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("due") - passes * F.col("words")
    partial = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - before))
    taken = F.coalesce(passes * F.col("size") + partial, F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"))

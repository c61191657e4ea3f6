"""Analytics of tidy run rows ``(dataset, technique, params, protocol, map, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameter(name: str, default: object = None) -> Column:
    """A parameter as text; the default only where the key is absent, as an explicit null stays one."""
    held = F.col("params")
    return F.when(F.map_contains_key(held, name), held[name]).otherwise(F.lit(None if default is None else str(default)))


def at_protocol(rows: DataFrame, native: tuple[str, ...] = ("siglip2", "deit"), size: int = 224) -> DataFrame:
    """Rows at the published protocol: padded, bicubic, native read-out, no whitening, and ``size`` but for families of a fixed size."""
    fixed = F.split_part(parameter("model"), F.lit("-"), F.lit(1)).isin(*native)
    plain = (parameter("resize", "pad") == "pad") & (parameter("readout", "native") == "native") & (parameter("interpolation", "bicubic") == "bicubic")
    return rows.filter(plain & (parameter("whiten", "false") == "false") & (fixed | (parameter("image_size").cast("int") == size)))


def best_rows(rows: DataFrame, group: list[str], axis: str, value: str) -> DataFrame:
    """All rows at the axis value of each group's best row; of equal ones, the smaller axis value."""
    best = rows.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.max_by(axis, F.struct(F.col(value), -F.col(axis))).alias(axis))
    return rows.join(F.broadcast(best), [*group, axis])


def two_level(rows: DataFrame, index: str, columns: list[str], value: str, levels: list[str]) -> DataFrame:
    """Mean per index and pair of column values, one column for each of the ``levels`` ``a/b``."""
    return rows.groupBy(index).pivot("_level", levels).agg(F.avg(value)) if "_level" in rows.columns else two_level(rows.withColumn("_level", F.concat_ws("/", *columns)), index, columns, value, levels)


def complete_pivot(rows: DataFrame, index: str, column: str, value: str, levels: list[str]) -> DataFrame:
    """Best value per index and level; only indices that have all."""
    return rows.groupBy(index).pivot(column, levels).agg(F.max(value)).na.drop()


def before_after(after: DataFrame, before: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows with the best value that the other rows have at their key, and the change from it; null without one."""
    held = before.groupBy(*key).agg(F.max(value).alias("before"))
    return after.join(held, key, "left").withColumn("change", F.col(value) - F.col("before"))


def with_targets(rows: DataFrame, targets: list[tuple], key: list[str], kinds: str) -> DataFrame:
    """Rows with the published ``target`` of their key, null without one. ``targets`` is a short list from a paper."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(targets, f"{kinds}, target double")), key, "left")


def category(column: str, order: list[str]) -> Column:
    """The place of a value in an explicit order; others last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(place == 0, len(order) + 1).otherwise(place)


def in_order(rows: DataFrame, column: str, *keys: Column) -> DataFrame:
    """``(column, place)``: distinct values in order of the least of their keys."""
    from pyspark.sql import Window

    least = rows.groupBy(column).agg(F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).alias("_k"))
    return least.select(column, (F.row_number().over(Window.orderBy("_k", column)) - 1).cast("long").alias("place"))


def increments(rows: DataFrame, group: str, axis: str, value: str) -> DataFrame:
    """Gain of each point of a sweep over the one before it."""
    from pyspark.sql import Window

    return rows.select(group, axis, (F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(axis))).alias("gain"))


def available(rows: DataFrame, key: str, value: str, needed: list[str]) -> DataFrame:
    """Keys that have every needed value."""
    held = rows.groupBy(key).agg(F.collect_set(value).alias("_s"))
    return held.filter(F.size(F.array_except(F.array(*map(F.lit, needed)), "_s")) == 0).select(key)


def several(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value, and how many."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("kinds")).filter("kinds > 1")


def best_where(rows: DataFrame, key: str, condition: Column, value: str) -> DataFrame:
    """The best value that meets a condition, null if none does, and the least of all."""
    return rows.groupBy(key).agg(F.max(F.when(condition, F.col(value))).alias("best"), F.min(value).alias("low"))

"""Training-side queries: pairs, hard negatives, losses, validation, early stopping."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import squared_distance
from .search import NONE, against, descending, places


def mine_negatives(scored: DataFrame, k: int = 5) -> DataFrame:
    """Of ``(query_id, query_cluster, image_id, cluster, sim)``: the best of each other cluster, then the k best."""
    other = scored.filter(F.col("cluster") != F.col("query_cluster"))
    best = Window.partitionBy("query_id", "cluster").orderBy(F.col("sim").desc(), "image_id")
    one = other.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "image_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "image_id", "cluster", "rank")


def hardest(queries: DataFrame, database: DataFrame, k: int = 5) -> DataFrame:
    """``mine_negatives`` of ``(id, vec, label)`` rows, where the scores are made."""

    def make(ids, marks, *_):
        order = np.argsort(marks, kind="stable")
        clusters, starts = np.unique(marks[order], return_index=True)
        ends = np.append(starts[1:], len(order))

        def visit(q, own, s):
            if s is None or own == NONE or not len(s):
                return None
            s = s[order]
            top = np.maximum.reduceat(s, starts)
            some = np.flatnonzero((clusters != own) & (clusters != NONE))
            some = some[_least_of_best(top[some], k)]
            at = np.array([starts[c] + np.argmax(s[starts[c] : ends[c]]) for c in some], np.int64)
            by = np.lexsort((ids[order[at]], -top[some], ~np.isnan(top[some])))[:k]
            return np.full(len(by), q), ids[order[at[by]]], clusters[some[by]], np.arange(1, len(by) + 1, dtype=np.int32)

        return visit

    out = against(queries, database, make, "query_id long, image_id long, cluster long, rank int", "label")
    return out.withColumn("cluster", F.col("cluster").cast(database.schema["label"].dataType))


def _least_of_best(top: np.ndarray, k: int) -> np.ndarray:
    """Places of all values as high as the k-th best."""
    order = descending(top)
    if len(order) <= k or np.isnan(top).any():
        return order
    return np.flatnonzero(top >= top[order[k - 1]])


def sample_epoch(pairs: DataFrame, pool: DataFrame, n_pairs: int, n_pool: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Seeded samples of pairs and of the pool, without replacement."""
    take = lambda df, key, n: df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
    return take(pairs, "pair_id", n_pairs), take(pool, "id", n_pool)


def pair_endpoints(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("q").alias("id")).union(pairs.select(F.col("p").alias("id"))).distinct()


def dense_remap(ids: DataFrame, key: str = "id") -> DataFrame:
    """``(id, dense)`` in order of ids: ranges are sorted over the cluster, counted, and numbered from their offset."""
    part = ids.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    counts = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return part.withColumn("_i", place).join(F.broadcast(offsets), "_p").select(key, (F.col("_i") + F.col("_o")).cast("long").alias("dense"))


def contrastive_loss(tuples: DataFrame, margin: float) -> DataFrame:
    """``(query_id, loss)`` of ``(query_id, q, p, negatives)`` vectors: half of squared distances and hinges."""
    hinge = F.transform("negatives", lambda n: F.pow(F.greatest(F.lit(margin) - F.sqrt(squared_distance(F.col("q"), n)), F.lit(0.0)), F.lit(2.0)))
    loss = 0.5 * (squared_distance(F.col("q"), F.col("p")) + F.aggregate(hinge, F.lit(0.0), lambda a, x: a + x))
    return tuples.select("query_id", loss.alias("loss"))


def nearest_other(vectors: DataFrame) -> DataFrame:
    """``(query_id, image_id, sim)``: the best other row by inner product, ties to the smaller id."""

    def make(ids, *_):
        def visit(q, _, s):
            if s is None:
                return None
            low, high = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
            ends = [part.start + np.argmax(s[part]) for part in (slice(0, low), slice(high, len(s))) if part.start < part.stop]
            at = np.array(ends, np.int64)
            at = at[descending(s[at])][:1]
            return np.full(len(at), q), ids[at], s[at]

        return visit

    return against(vectors, vectors, make, "query_id long, image_id long, sim double")


def koleo(vectors: DataFrame) -> DataFrame:
    """Entropy of unit vectors: minus the mean log distance to the nearest other."""
    near = F.sqrt(F.greatest(2.0 - 2.0 * F.col("sim"), F.lit(0.0)))
    return nearest_other(vectors).agg(F.avg(-F.log(near + 1e-8)).alias("koleo"))


def knn_precision(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of rows whose nearest other row has their label."""
    a = labels.select(F.col("id").alias("query_id"), F.col("label").alias("a"))
    b = labels.select(F.col("id").alias("image_id"), F.col("label").alias("b"))
    return nearest_other(vectors).join(a, "query_id").join(b, "image_id").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("precision_at_1"))


def knn_average_precision(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean over rows of the average precision of their label in the ranking of all others; rows alone with their label do not count."""
    rows = vectors if labels is vectors else vectors.select("id", "vec").join(labels.select("id", "label"), "id", "left")

    def make(ids, marks, *_):
        def visit(q, own, s):
            if s is None or own == NONE:
                return None
            low, high = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
            same = np.flatnonzero(marks == own)
            same = np.concatenate([same[same < low], same[same >= high] - (high - low)])
            if len(same):
                place = np.sort(places(np.delete(s, slice(low, high)), same)) + 1
                return np.array([q]), np.array([np.mean(np.arange(1, len(place) + 1) / place)])

        return visit

    return against(rows, rows, make, "query_id long, ap double", "label").agg(F.avg("ap").alias("mean_average_precision"))


def stopped_epochs(curves: DataFrame, patience: int = 5, min_delta: float = 0.001) -> DataFrame:
    """``(run, epochs, best)`` of curves ``(run, epoch, score)``: epochs until patience runs out, and the best score among them."""
    past = Window.partitionBy("run").orderBy("epoch")
    before = F.max("score").over(past.rowsBetween(Window.unboundedPreceding, -1))
    gained = F.when(before.isNull() | (F.col("score") > before + min_delta), F.col("epoch"))
    marked = curves.withColumn("gained", gained)
    marked = marked.withColumn("since", F.col("epoch") - F.last("gained", True).over(past.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy("run").agg(F.coalesce(F.min(F.when(F.col("since") >= patience, F.col("epoch"))), F.max("epoch")).alias("stop"))
    ran = curves.join(ends, "run").filter("epoch <= stop")
    return ran.groupBy("run").agg(F.count(F.lit(1)).alias("epochs"), F.max("score").alias("best"))


def early_stop(scores_by_epoch: Iterable[float], patience: int | None = 5, min_delta: float = 0.001) -> tuple[int, float]:
    """Epochs run and the best score; gains up to ``min_delta`` move the best but not the patience."""
    best, since, epoch = float("-inf"), 0, -1
    for epoch, score in enumerate(scores_by_epoch):
        if score > best + min_delta:
            since = epoch
        best = max(best, score)
        if patience is not None and epoch - since >= patience:
            break
    return epoch + 1, best

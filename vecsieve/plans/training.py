"""The training loop around a model that is not part of the library: sampling, mining, validation, early stopping, resumption."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mining
from ..operators.search import scores
from ..sources import tables
from ..sources.corpus import Corpus
from .config import Train

Describe = Callable[[DataFrame], DataFrame]
Step = Callable[[DataFrame, int], None]


def mined_tuples(corpus: Corpus, describe: Describe, config: Train, epoch: int) -> DataFrame:
    """``(query_id, image_id, cluster, rank)``: the epoch's hard negatives against the current model."""
    pairs, pool = mining.sample_epoch(corpus.pairs, corpus.images.select("id"), config.pairs, config.pool, config.seed + epoch)
    cluster = corpus.images.select("id", "cluster")
    found = scores(describe(pairs.select(F.col("q").alias("id")).distinct()), describe(pool))
    found = found.join(cluster.select(F.col("id").alias("query_id"), F.col("cluster").alias("query_cluster")), "query_id")
    return mining.mine_negatives(found.join(cluster.withColumnRenamed("id", "image_id"), "image_id"), config.negatives)


def train(spark: SparkSession, corpus: Corpus, describe: Describe, step: Step, validate: Callable[[int], float], config: Train, state_path: str | None = None, log: Callable[[str], None] = print) -> dict:
    """Epochs until they, or the patience, run out; the state after each. An epoch's seed is the base's plus its number, so a resumed run equals a fresh one."""
    path = f"{state_path}/state" if state_path else None
    state = {"epoch": 0, "scores": [], "best": None, "best_epoch": None}
    if path and tables.exists(spark, path):
        state = tables.read_state(spark, path)
    while state["epoch"] < config.epochs:
        if _stalled(state["scores"], config):
            break
        began, epoch = time.time(), state["epoch"]
        step(mined_tuples(corpus, describe, config, epoch), epoch)
        score = float(validate(epoch))
        better = state["best"] is None or score > state["best"]
        state = {"epoch": epoch + 1, "scores": [*state["scores"], score], "best": score if better else state["best"], "best_epoch": epoch if better else state["best_epoch"]}
        if path:
            tables.write_state(spark, path, state)
        log(f"epoch {epoch}: {score:.4f} in {time.time() - began:.0f} s")
    return state


def _stalled(told: list[float], config: Train) -> bool:
    """Whether the scores so far have used up the patience."""
    best, since = float("-inf"), 0
    for epoch, score in enumerate(told):
        if score > best + config.min_delta:
            since = epoch
        best = max(best, score)
    return config.patience is not None and bool(told) and len(told) - 1 - since >= config.patience

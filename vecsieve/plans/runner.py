"""From descriptors of a split to a scored, recorded run."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import fit, metrics, search
from ..sources import runlog
from ..sources.tables import Store, exists
from .config import Bow, Fisher, Run, Vlad, params


@dataclass(frozen=True)
class Inputs:
    """Local or global descriptors of the held-out, database and query images, and the truth.

    Local: ``(image_id, kp, vec)``. Global: ``(id, vec)``. ``database_ids`` and ``query_ids``
    name all images, those without descriptors too.
    """

    held_out: DataFrame
    database: DataFrame
    queries: DataFrame
    database_ids: DataFrame
    query_ids: DataFrame
    truth: DataFrame
    learned: dict[str, fit.PCA] | None = None  # of one scale ("ss") and of several ("ms")


class Extractor(Protocol):
    """Turns images into descriptors; models are loaded once per task."""

    def describe(self, images: DataFrame) -> DataFrame: ...


def map_images(images: DataFrame, load: Callable[[], Callable[[bytes], np.ndarray]]) -> DataFrame:
    """``(image_id, kp, vec)`` from ``(image_id, content)`` by a model that each task loads once."""
    import pyarrow as pa

    def run(batches):
        model = load()
        for batch in batches:
            for image, content in zip(batch["image_id"].to_pylist(), batch["content"].to_pylist()):
                rows = np.atleast_2d(model(content))
                columns = [pa.array([image] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(rows.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["image_id", "kp", "vec"])

    return images.mapInArrow(run, "image_id long, kp int, vec array<double>")


def _full(sims: DataFrame, queries: DataFrame, database: DataFrame) -> DataFrame:
    """Ranks of all database images; those that share no coordinate with the query score 0."""
    from pyspark.sql import Window

    every = search.pairs(queries, database)
    scored = every.join(sims, ["query_id", "image_id"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "image_id")
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def codebook(run: Run, inputs: Inputs, store: Store | None) -> np.ndarray:
    """The vocabulary of the held-out descriptors; bag of words and VLAD share it, and with a store it is fitted once."""
    d, spark = run.descriptor, inputs.held_out.sparkSession
    make = lambda: fit.train_vocabulary(inputs.held_out, d.k, d.seed)
    if store is None:
        return make()
    key = {"dataset": run.split.held_out_dataset, "k": d.k, "seed": d.seed}
    rows = store.get("kmeans", lambda: spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(make())], "word int, center array<double>"), **key)
    return np.array([r["center"] for r in sorted(rows.select("word", "center").collect())])


def mixture(run: Run, inputs: Inputs, store: Store | None) -> E.Mixture:
    """The mixture of a seeded sample of the held-out descriptors, fitted once with a store."""
    d, spark = run.descriptor, inputs.held_out.sparkSession

    def make() -> E.Mixture:
        some = fit.seeded_sample(inputs.held_out.withColumn("_k", F.xxhash64("image_id", "kp")), "_k", d.sample, d.seed).drop("_k")
        centers = fit.train_vocabulary(some, d.k, d.seed)
        return fit.train_mixture(some, E.Mixture(np.full(d.k, 1 / d.k), centers, np.ones(centers.shape)))

    if store is None:
        return make()

    def table() -> DataFrame:
        m = make()
        return spark.createDataFrame([(i, float(w), mu.tolist(), v.tolist()) for i, (w, mu, v) in enumerate(zip(m.weights, m.means, m.variances))], "comp int, w double, mu array<double>, var array<double>")

    rows = sorted(store.get("gmm", table, dataset=run.split.held_out_dataset, k=d.k, seed=d.seed, sample=d.sample).select("comp", "w", "mu", "var").collect())
    return E.Mixture(*(np.array([r[k] for r in rows]) for k in ("w", "mu", "var")))


def projection(run: Run, inputs: Inputs) -> fit.PCA | None:
    """What a global descriptor is projected by: the learned whitening, a fit on held-out data, or nothing."""
    d = run.descriptor
    if getattr(d, "whiten_source", None) == "learned":
        if not inputs.learned:
            raise ValueError("these inputs hold no learned whitening")
        return inputs.learned["ss" if len(d.scales) == 1 else "ms"].leading(d.dim)
    whiten = getattr(d, "whiten", False)
    if d.dim is None and not whiten:
        return None
    width = d.dim or len(inputs.held_out.first()["vec"])
    return fit.pca_fit(inputs.held_out, width, whiten, getattr(d, "shrinkage", 0.0))


def rank(run: Run, inputs: Inputs, store: Store | None = None) -> DataFrame:
    """Full ranking of a configuration."""
    d = run.descriptor
    if isinstance(d, Bow):
        centers = codebook(run, inputs, store)
        # counted once, for the idf and for the encoding
        tf = E.term_frequencies(search.nearest(inputs.database, centers)).persist()
        words = inputs.database.sparkSession.range(len(centers)).select(F.col("id").cast("int").alias("word"))
        idf = E.inverse_document_frequency(tf, inputs.database_ids, words)
        q = E.tfidf(E.term_frequencies(search.nearest(inputs.queries, centers)), idf)
        return _full(E.sparse_scores(q, E.tfidf(tf, idf), ["word"]), inputs.query_ids, inputs.database_ids)
    if isinstance(d, Vlad):
        centers = codebook(run, inputs, store)
        code = lambda x: E.vlad_encode(E.vlad_raw(x, centers), d.power, d.intra_norm)
        return _full(E.sparse_scores(code(inputs.queries), code(inputs.database), ["word", "dim"], "value"), inputs.query_ids, inputs.database_ids)
    if isinstance(d, Fisher):
        model = mixture(run, inputs, store)
        code = lambda x: E.fisher_encode(E.fisher_raw(x, model), d.power)
        return _full(E.sparse_scores(code(inputs.queries), code(inputs.database), ["part", "comp", "dim"], "value"), inputs.query_ids, inputs.database_ids)
    model = projection(run, inputs)
    through = (lambda x: x) if model is None else model.transform
    return search.rank(through(inputs.queries), through(inputs.database))


def learn_whitening(vectors: dict[str, DataFrame], pairs: DataFrame) -> dict[str, fit.PCA]:
    """Both variants, of one scale and of several, from descriptors and matching pairs."""
    return {variant: fit.supervised_whitening(rows, pairs) for variant, rows in vectors.items()}


def attach(spark: SparkSession, path: str, learned: dict[str, fit.PCA]) -> None:
    """Write projections beside what a folder holds; a variant is replaced as a whole."""
    for variant, model in learned.items():
        rows = [(i, c.tolist(), model.mean.tolist()) for i, c in enumerate(model.components)]
        spark.createDataFrame(rows, "i int, component array<double>, mean array<double>").write.mode("overwrite").parquet(f"{path}/whitening={variant}")


def attached(spark: SparkSession, path: str) -> dict[str, fit.PCA]:
    out = {}
    for variant in ("ss", "ms"):
        if exists(spark, f"{path}/whitening={variant}"):
            rows = sorted(spark.read.parquet(f"{path}/whitening={variant}").select("i", "component", "mean").collect())
            out[variant] = fit.PCA(np.array(rows[0]["mean"]), np.array([r["component"] for r in rows]))
    return out


def run_one(spark: SparkSession, run: Run, inputs: Inputs, log: str | None = None, store: Store | None = None) -> runlog.RunRecord:
    began = time.time()
    ids = inputs.query_ids.select(F.col("id").alias("query_id"))
    rows = metrics.evaluate(metrics.query_metrics(rank(run, inputs, store), inputs.truth, ids, run.mp_at_k), run.mp_at_k).collect()
    found = {r["protocol"]: {k: r[k] for k in ("map", "mp_at_k", "k", "num_queries", "num_excluded")} for r in rows}
    record = runlog.RunRecord(run.dataset, run.split.held_out_dataset, run.descriptor.technique, params(run.descriptor), found, time.time() - began)
    if log:
        runlog.append(spark, record, log)
    return record


def run_all(spark: SparkSession, runs: Iterable[Run], prepare: Callable[[Run], Inputs], log: str | None = None, store: Store | None = None) -> list[runlog.RunRecord]:
    """Runs in order; inputs are prepared once per dataset and kind of descriptor, and each record is kept at once."""
    held: dict[tuple[str, bool], Inputs] = {}
    out = []
    for run in runs:
        key = (run.dataset, isinstance(run.descriptor, Bow | Vlad | Fisher))
        held.setdefault(key, prepare(run)) if key not in held else None
        out.append(run_one(spark, run, held[key], log, store))
    return out

"""Fits: k-means, diagonal EM, PCA with whitening, supervised whitening.

Sums run over the cluster as per-batch matrix products; factorisations of d by d matrices
run on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import Mixture
from .search import dense, nearest_words, slabs, whole

FLOOR = 1e-12


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows least by a hash of key and seed, without replacement; all if n is 0 or too large."""
    if n <= 0:
        return df
    place = F.pmod(F.pmod(F.col(key), F.lit(2**30)) * F.lit(2654435761) + F.lit(seed), F.lit(2**32))
    return df.orderBy(place, key).limit(n)


def _sums(names: str, sums: np.ndarray, key: str) -> pa.RecordBatch:
    """(k, d, values) as long rows."""
    k, d, _ = sums.shape
    one, dim = np.divmod(np.arange(k * d, dtype=np.int32), d)
    columns = [one, dim, *sums.reshape(k * d, -1).T]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], [key, "dim", *names])


def lloyd_sums(local: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(word, dim, s, n)``: sums and numbers of the descriptors of each word, one row a task before the shuffle."""

    def run(batches):
        sums = np.zeros((*centers.shape, 2))
        for batch in batches:
            if len(batch):
                x = dense(batch["vec"])
                word = nearest_words(x, centers)
                np.add.at(sums[:, :, 0], word, x)
                sums[:, :, 1] += np.bincount(word, minlength=len(centers))[:, None]
        yield _sums("sn", sums, "word")

    part = whole(local).select("vec").mapInArrow(run, "word int, dim int, s double, n double")
    return part.groupBy("word", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def lloyd_step(local: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(word, dim, c)``: means of the descriptors assigned to each word."""
    return lloyd_sums(local, centers).filter("n > 0").select("word", "dim", (F.col("s") / F.col("n")).alias("c"))


def _table(rows: pa.Table, shape: tuple[int, int], key: str, *values: str) -> list[np.ndarray]:
    """Columns of long rows as (k, d) arrays; NaN where there is no row."""
    out = []
    for v in values:
        held = np.full(shape, np.nan)
        held[rows[key].to_numpy(), rows["dim"].to_numpy()] = rows[v].to_numpy()
        out.append(held)
    return out


def lloyd(local: DataFrame, centers: np.ndarray, steps: int = 20, tolerance: float = 1e-6) -> np.ndarray:
    """Lloyd iterations from given centres; a word that loses all descriptors keeps its centre."""
    for _ in range(steps):
        (new,) = _table(lloyd_step(local, centers).toArrow(), centers.shape, "word", "c")
        new = np.where(np.isnan(new), centers, new)
        if np.abs(new - centers).max() < tolerance:
            return new
        centers = new
    return centers


def mini_batches(local: DataFrame, centers: np.ndarray, key: str, steps: int = 20, share: int = 8, seed: int = 0) -> np.ndarray:
    """Mini-batch k-means: each step moves the centres towards the mean of one part in ``share``, by what they have seen so far."""
    seen = np.zeros(len(centers))
    dealt = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(share))
    for step in range(steps):
        s, n = _table(lloyd_sums(local.filter(dealt == step % share), centers).toArrow(), centers.shape, "word", "s", "n")
        s, n = np.nan_to_num(s), np.nan_to_num(n)[:, 0]
        seen += n
        rate = np.divide(n, seen, out=np.zeros_like(seen), where=seen > 0)[:, None]
        mean = np.divide(s, n[:, None], out=centers.copy(), where=n[:, None] > 0)
        centers = centers + rate * (mean - centers)
    return centers


def train_vocabulary(local: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="features").fit(whole(local).select(array_to_vector("vec").alias("features")))
    return np.array(model.clusterCenters())


def em_step(local: DataFrame, mixture: Mixture) -> DataFrame:
    """``(comp, dim, weight, mean, variance)`` after one expectation-maximisation step; sums are taken per task."""
    k, d = mixture.means.shape

    def run(batches):
        sums = np.zeros((k, d, 4))
        for batch in batches:
            x = dense(batch["vec"]) if len(batch) else np.zeros((0, d))
            for part in slabs(len(x), k):
                y, g = x[part], mixture.responsibilities(x[part])
                for at, v in enumerate((g.sum(0)[:, None], g.T @ y, g.T @ y**2, len(y))):
                    sums[:, :, at] += v
        yield _sums(["n", "s", "q", "t"], sums, "comp")

    part = whole(local).select("vec").mapInArrow(run, "comp int, dim int, n double, s double, q double, t double")
    sums = part.groupBy("comp", "dim").agg(*[F.sum(c).alias(c) for c in "nsqt"])
    mean = F.col("s") / F.col("n")
    return sums.select("comp", "dim", (F.col("n") / F.col("t")).alias("weight"), mean.alias("mean"), F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(FLOOR)).alias("variance"))


def train_mixture(local: DataFrame, start: Mixture, steps: int = 100, tolerance: float = 1e-3) -> Mixture:
    """Expectation-maximisation until no mean moves by more than the tolerance."""
    for _ in range(steps):
        w, m, v = _table(em_step(local, start).toArrow(), start.means.shape, "comp", "weight", "mean", "variance")
        moved = np.abs(m - start.means).max()
        start = Mixture(w[:, 0], m, v)
        if moved < tolerance:
            break
    return start


def _moments(batches):
    n, s, g = 0, None, None
    for batch in batches:
        if len(batch):
            x = dense(batch["vec"])
            n, s, g = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if g is None else g + x.T @ x
    if n:
        d = len(s)
        i, j = np.divmod(np.arange(d * d), d)
        columns = [i.astype(np.int32), j.astype(np.int32), g.ravel(), np.repeat(s, d), np.tile(s, d), np.full(d * d, n)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "g", "si", "sj", "n"])


def gram(vectors: DataFrame) -> DataFrame:
    """``(i, j, g, si, sj, n)``: sums of products and of values over all rows of ``vec``."""
    part = whole(vectors.select(F.col("vec").cast("array<double>").alias("vec"))).mapInArrow(_moments, "i int, j int, g double, si double, sj double, n long")
    return part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("g", "si", "sj", "n")])


def covariance(vectors: DataFrame) -> DataFrame:
    """``(i, j, cov)`` with denominator n - 1."""
    n = F.col("n")
    return gram(vectors).select("i", "j", ((F.col("g") - F.col("si") * F.col("sj") / n) / (n - 1)).alias("cov"))


def _dense(rows, value: str) -> np.ndarray:
    d = max(r["i"] for r in rows) + 1
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"], r["j"]] = r[value]
    return out


@dataclass(frozen=True)
class PCA:
    mean: np.ndarray
    components: np.ndarray

    def leading(self, dim: int | None) -> PCA:
        """The first ``dim`` components; all if None."""
        if dim is not None and not 1 <= dim <= len(self.components):
            raise ValueError(f"dim must be in 1..{len(self.components)}, got {dim}")
        return PCA(self.mean, self.components[:dim])

    def transform(self, vectors: DataFrame) -> DataFrame:
        """``vec`` replaced by its unit projection; rows without a whole vector go."""
        mean, components, names = self.mean, self.components, vectors.columns

        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                x = dense(batch["vec"])
                y = (x - mean) @ components.T
                norm = np.linalg.norm(y, axis=1, keepdims=True)
                y = np.divide(y, norm, out=np.zeros_like(y), where=norm > 0)
                columns = [pa.array(list(y), pa.list_(pa.float64())) if c == "vec" else batch[c] for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

        schema = ", ".join(f"{f.name} {'array<double>' if f.name == 'vec' else f.dataType.simpleString()}" for f in vectors.schema.fields)
        return whole(vectors).mapInArrow(run, schema)


def pca_fit(vectors: DataFrame, dim: int, whiten: bool = False, shrinkage: float = 0.0) -> PCA:
    """Principal components; whitening divides each by sqrt(variance + shrinkage * mean variance kept)."""
    rows = gram(vectors).collect()
    if shrinkage < 0 or not rows:
        raise ValueError("shrinkage must not be negative and there must be vectors")
    n, g = rows[0]["n"], _dense(rows, "g")
    mean = _dense(rows, "si")[:, 0] / n
    if not 1 <= dim <= min(len(g), n):
        raise ValueError("dim must be between 1 and the width and number of the vectors")
    values, axes = np.linalg.eigh((g - n * np.outer(mean, mean)) / max(1, n - 1))
    order = np.argsort(-values)[:dim]
    values, axes = values[order], axes[:, order].T
    return PCA(mean, axes / np.sqrt(np.maximum(values + shrinkage * values.mean(), FLOOR))[:, None] if whiten else axes)


def pair_differences(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(q, p, vec, x)``: difference of a matching pair, and the query-side vector."""
    a = vectors.select(F.col("id").alias("q"), F.col("vec").alias("x"))
    b = vectors.select(F.col("id").alias("p"), F.col("vec").alias("y"))
    return pairs.join(a, "q").join(b, "p").select("q", "p", F.zip_with("x", "y", lambda x, y: x - y).alias("vec"), "x")


def supervised_whitening(vectors: DataFrame, pairs: DataFrame) -> PCA:
    """Projection that makes differences of matching pairs white, axes by descending scatter of all vectors."""
    diff = pair_differences(vectors, pairs)
    rows, means = gram(diff).collect(), gram(diff.select(F.col("x").alias("vec"))).collect()
    if not rows or rows[0]["n"] < len(_dense(rows, "g")):
        raise ValueError("there must be as many pairs as dimensions")
    mean = _dense(means, "si")[:, 0] / means[0]["n"]
    inverse = np.linalg.inv(np.linalg.cholesky(_dense(rows, "g") / rows[0]["n"]))
    every = gram(vectors).collect()
    n, s = every[0]["n"], _dense(every, "si")[:, 0]
    scatter = _dense(every, "g") - np.outer(s, mean) - np.outer(mean, s) + n * np.outer(mean, mean)
    values, axes = np.linalg.eigh(inverse @ scatter @ inverse.T)
    return PCA(mean, axes[:, np.argsort(-values)].T @ inverse)

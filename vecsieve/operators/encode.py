"""Aggregated descriptors in long form: bag of words, VLAD, Fisher vectors.

Local descriptors are rows ``(image_id, kp, vec)``. Encodings stay sparse and long,
``(image_id, word, dim, value)``, so that their memory does not grow with the codebook.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import dense, nearest_words, rounded, slabs, whole

# ids in a packed row at most; images that are written with query after query, and queries at a time
COPIES, FEW_IMAGES, MANY_QUERIES = 64, 256, 2048


def _batches(batches):
    """Images and vectors of batches of local descriptors."""
    for batch in batches:
        if len(batch):
            images, at = np.unique(batch["image_id"].to_numpy(), return_inverse=True)
            yield batch, images, at, dense(batch["vec"])


def _long(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def term_frequencies(words: DataFrame) -> DataFrame:
    return words.groupBy("image_id", "word").agg(F.count(F.lit(1)).alias("tf"))


def inverse_document_frequency(tf: DataFrame, images: DataFrame, words: DataFrame) -> DataFrame:
    """``(word, idf)``: ln(images / images with the word), empty images counted; 0 for unseen words."""
    n = images.count()
    seen = tf.groupBy("word").agg(F.countDistinct("image_id").alias("df"))
    return words.join(seen, "word", "left").select("word", F.when(F.col("df").isNull(), 0.0).otherwise(F.log(F.lit(float(n)) / F.col("df"))).alias("idf"))


def seen_idf(tf: DataFrame, images: DataFrame) -> DataFrame:
    """``inverse_document_frequency`` of the words that occur, counted from term frequencies of one row per image and word."""
    n = images.count()
    return tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", F.log(F.lit(float(n)) / F.col("df")).alias("idf"))


def unit(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Value over the L2 norm of its key's values; zero stays zero."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(*key)))
    return df.withColumn("_n", norm).withColumn(value, F.when(F.col("_n") == 0, 0.0).otherwise(F.col(value) / F.col("_n"))).drop("_n")


def tfidf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """``(image_id, word, w)``; the idf is the database's, for queries too."""
    return unit(tf.join(idf, "word").select("image_id", "word", (F.col("tf") * F.col("idf")).alias("w")), ["image_id"], "w")


def _rows_of(batch: pa.RecordBatch, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, coordinate and value of each entry of a slice of packed rows."""
    part = batch.slice(at.start, at.stop - at.start)
    n = part["c"].value_lengths().to_numpy()
    return np.repeat(np.arange(len(part)), n), part["c"].flatten().to_numpy(), part["v"].flatten().to_numpy()


def _matrix(entries: tuple, rows: int, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the terms, and ones where a row has the term."""
    row, term, value = entries
    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
    held = terms[at] == term
    x, there = np.zeros((rows, len(terms))), np.zeros((rows, len(terms)), np.float32)
    np.add.at(x, (row[held], at[held]), value[held])
    there[row[held], at[held]] = 1
    return x, there


def _meet(batches, digits: int | None = None):
    """Sums of products of every query, which come first, with every row that shares a coordinate with it; a row stands for all its ids."""
    queries = []
    for batch in batches:
        asked = batch["_q"].to_numpy(zero_copy_only=False)
        if asked.any():
            queries.append(batch.filter(pa.array(asked)))
        rows = batch.filter(pa.array(~asked))
        for q in queries if len(rows) else []:
            for some in slabs(len(q), max(1 << 12, len(q["c"].flatten().unique()))):
                some = slice(some.start, min(some.stop, len(q)))
                entries = _rows_of(q, some)
                terms = np.unique(entries[1])
                a, shared = _matrix(entries, some.stop - some.start, terms)
                for part in slabs(len(rows), max(1 << 10, len(terms))):
                    part = slice(part.start, min(part.stop, len(rows)))
                    b, there = _matrix(_rows_of(rows, part), part.stop - part.start, terms)
                    s, both = a @ b.T, shared @ there.T > 0
                    for i in slabs(*s.shape):
                        s[i] = rounded(s[i].ravel(), digits).reshape(s[i].shape)
                    yield from _spread(_ids(q, some), _ids(rows, part), s, both)


def _ids(batch: pa.RecordBatch, at: slice) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a slice of packed rows, and their row in it."""
    ids = batch["ids"].slice(at.start, at.stop - at.start)
    return ids.flatten().to_numpy(), np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy())


def _spread(queries: tuple, images: tuple, s: np.ndarray, both: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the pairs in ``both``, a few images with query after query: columns then repeat themselves at short distances, and files of them stay small."""
    (query, row), (image, column) = queries, images
    for at in range(0, len(image), FEW_IMAGES):
        some, where = image[at : at + FEW_IMAGES], column[at : at + FEW_IMAGES]
        sims, shared = s[:, where], both[:, where]
        for start in range(0, len(query), MANY_QUERIES):
            asked, own = query[start : start + MANY_QUERIES], row[start : start + MANY_QUERIES]
            met = shared[own]
            yield _long(["query_id", "image_id", "sim"], np.repeat(asked, met.sum(1)), np.broadcast_to(some, met.shape)[met], sims[own][met])


def sparse_scores(queries: DataFrame, database: DataFrame, key: list[str], value: str = "w", block: int = 16384, digits: int | None = None, copies: bool = False) -> DataFrame:
    """``(query_id, image_id, sim)`` of the pairs that share a coordinate. Queries in blocks meet slices of the database, each pair in one task; coordinates are told apart by 64-bit hashes. ``digits`` rounds the sums where they are made. With ``copies`` rows of equal values are scored once and lie side by side."""

    def packed(df: DataFrame) -> DataFrame:
        one = F.sort_array(F.collect_list(F.struct(F.xxhash64(*key).alias("c"), F.col(value).alias("v"))))
        out = df.filter(F.col(value).isNotNull()).groupBy("image_id").agg(one.alias("e")).select("image_id", F.col("e.c").alias("c"), F.col("e.v").alias("v"))
        if not copies:
            return out.select(F.array("image_id").alias("ids"), "c", "v", F.xxhash64("image_id").alias("_o"), F.xxhash64("image_id").alias("_d"))
        out = out.groupBy("c", "v").agg(F.sort_array(F.collect_list("image_id")).alias("ids"))
        some = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / COPIES).cast("int")), lambda i: F.slice("ids", i * COPIES + 1, F.lit(COPIES)))
        # values that differ in their last digits only are neighbours too
        alike = F.xxhash64("c", F.transform("v", lambda x: F.round(x, 9)))
        out = out.select("c", "v", alike.alias("_o"), F.posexplode(some).alias("_n", "ids"))
        return out.select("ids", "c", "v", "_o", F.xxhash64("_o", "_n").alias("_d"))

    ids = queries.select("image_id").agg(F.approx_count_distinct("image_id")).first()[0]
    blocks, slices = 1 + ids // block, 2 * queries.sparkSession.sparkContext.defaultParallelism
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.col("_d"), F.lit(n)).cast("int")
    q = packed(queries).select("*", deal(blocks).alias("_b"), over(slices).alias("_s"), F.lit(True).alias("_q"))
    d = packed(database).select("*", over(blocks).alias("_b"), deal(slices).alias("_s"), F.lit(False).alias("_q"))
    dealt = q.unionByName(d).withColumn("_p", (F.col("_b") * slices + F.col("_s")).cast("int")).repartitionById(blocks * slices, "_p")
    return dealt.sortWithinPartitions(F.desc("_q"), "_o").select("ids", "c", "v", "_q").mapInArrow(partial(_meet, digits=digits), "query_id long, image_id long, sim double")


def power(value: str, alpha: float | None) -> Column:
    x = F.col(value)
    return x if alpha is None else F.signum(x) * F.pow(F.abs(x), F.lit(alpha))


def histograms(tf: DataFrame, images: DataFrame, words: DataFrame) -> DataFrame:
    """``(image_id, counts)``: one count per word for every image, zeros for those without descriptors."""
    size = words.count()
    held = tf.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "tf"))).alias("m"))
    every = images.select(F.col("id").alias("image_id")).join(held, "image_id", "left")
    one = lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0)).cast("long")
    return every.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one).alias("counts"))


def vlad_raw(local: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(image_id, word, dim, value)``: residual sums over the descriptors nearest to each word, summed per batch before the shuffle."""
    k, d = centers.shape

    def run(batches):
        for _, images, at, x in _batches(batches):
            word = nearest_words(x, centers)
            cell, where = np.unique(at * k + word, return_inverse=True)
            sums = np.zeros((len(cell), d))
            np.add.at(sums, where, x - centers[word])
            yield _long(["image_id", "word", "dim", "value"], np.repeat(images[cell // k], d), np.repeat((cell % k).astype(np.int32), d), np.tile(np.arange(d, dtype=np.int32), len(cell)), sums.ravel())

    part = whole(local).select("image_id", "vec").mapInArrow(run, "image_id long, word int, dim int, value double")
    return part.groupBy("image_id", "word", "dim").agg(F.sum("value").alias("value"))


def vlad_encode(raw: DataFrame, alpha: float | None = None, intra: bool = True) -> DataFrame:
    """Power law, then each block to unit length, then the whole."""
    out = raw.withColumn("value", power("value", alpha))
    out = unit(out, ["image_id", "word"], "value") if intra else out
    return unit(out, ["image_id"], "value")


class Mixture:
    """Diagonal Gaussian mixture: weights (k), means and variances (k, d)."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, variances: np.ndarray):
        self.weights, self.means, self.variances = weights, means, np.maximum(variances, 1e-12)
        if not (self.means.shape == self.variances.shape and len(weights) == len(means)):
            raise ValueError("shapes of weights, means and variances do not agree")

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        """(n, k) posteriors, by a soft maximum of the log joint densities."""
        v = self.variances
        constant = np.log(self.weights) - 0.5 * (x.shape[1] * math.log(2 * math.pi) + np.log(v).sum(1) + (self.means**2 / v).sum(1))
        joint = constant - 0.5 * (x**2 @ (1 / v).T) + x @ (self.means / v).T
        joint = np.exp(joint - joint.max(1, keepdims=True))
        return joint / joint.sum(1, keepdims=True)


def posteriors(local: DataFrame, mixture: Mixture) -> DataFrame:
    """``(image_id, kp, comp, gamma)``; the mixture is a model of k times d values."""
    k = len(mixture.weights)

    def run(batches):
        for batch, _, _, x in _batches(batches):
            for part in slabs(len(x), k):
                g = mixture.responsibilities(x[part])
                image, kp = (np.repeat(batch[c].to_numpy()[part], k) for c in ("image_id", "kp"))
                yield _long(["image_id", "kp", "comp", "gamma"], image, kp.astype(np.int32), np.tile(np.arange(k, dtype=np.int32), len(g)), g.ravel())

    return whole(local).select("image_id", "kp", "vec").mapInArrow(run, "image_id long, kp int, comp int, gamma double")


def fisher_raw(local: DataFrame, mixture: Mixture) -> DataFrame:
    """``(image_id, part, comp, dim, value)``; part 0 holds the gradients of means, part 1 those of deviations; summed per batch before the shuffle."""
    k, d = mixture.means.shape
    deviation = np.sqrt(mixture.variances)

    def run(batches):
        for _, images, at, x in _batches(batches):
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(len(images) + 1))
            for i, image in enumerate(images):
                own = x[order[edges[i] : edges[i + 1]]]
                m, s = np.zeros((k, d)), np.zeros((k, d))
                for part in slabs(len(own), k):
                    y, g = own[part], mixture.responsibilities(own[part])
                    zero, one, two = g.sum(0)[:, None], g.T @ y, g.T @ y**2
                    m += (one - zero * mixture.means) / deviation
                    s += (two - 2 * mixture.means * one + zero * mixture.means**2) / mixture.variances - zero
                comp, dim = np.divmod(np.arange(k * d, dtype=np.int32), d)
                yield _long(["image_id", "comp", "dim", "m", "s", "n"], np.full(k * d, image), comp, dim, m.ravel(), s.ravel(), np.full(k * d, len(own)))

    part = whole(local).select("image_id", "vec").mapInArrow(run, "image_id long, comp int, dim int, m double, s double, n long")
    sums = part.groupBy("image_id", "comp", "dim").agg(*[F.sum(c).alias(c) for c in ("m", "s", "n")])
    w = F.element_at(F.lit([float(x) for x in mixture.weights]), F.col("comp") + 1)
    both = F.array(F.col("m") / (F.col("n") * F.sqrt(w)), F.col("s") / (F.col("n") * F.sqrt(2 * w)))
    return sums.select("image_id", "comp", "dim", F.posexplode(both).alias("part", "value"))


def fisher_encode(raw: DataFrame, alpha: float = 0.5) -> DataFrame:
    return unit(raw.withColumn("value", power("value", alpha)), ["image_id"], "value")


def text_words(docs: DataFrame, most: int | None = None) -> DataFrame:
    """Lower-cased words of documents, all or those among the ``most`` frequent: ``(image_id, word)``."""
    words = docs.select(F.col("doc_id").alias("image_id"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word != ''")
    if most is None:
        return words
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(most).select("word")
    return words.join(top, "word")

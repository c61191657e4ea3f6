"""The training corpus: images with clusters, and matching pairs, per split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import reversed_hash_path


@dataclass(frozen=True)
class Corpus:
    """``images (id, cid, cluster)`` and ``pairs (pair_id, q, p)`` of a split."""

    images: DataFrame
    pairs: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str, split: str = "train") -> Corpus:
        read = lambda name: spark.read.parquet(f"{folder}/{name}").filter(F.col("split") == split).drop("split")
        return cls(read("images"), read("pairs"))

    def paths(self, root: str) -> DataFrame:
        return self.images.select("id", reversed_hash_path(root, F.col("cid")).alias("path"))


def shared_clusters(a: Corpus, b: Corpus) -> DataFrame:
    """Clusters that two splits share: none, if they are disjoint."""
    return a.images.select("cluster").intersect(b.images.select("cluster"))


def manifest_paths(manifest: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``(place, path)`` of a manifest ``(place, cid)``, in its order; a file that is not there is an error."""
    told = manifest.select("place", reversed_hash_path(root, F.col("cid")).alias("path"))
    found = told.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    sure = F.when(F.col("there"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no file "), F.col("path"))).cast("string"))
    return found.select("place", sure.alias("path")).orderBy("place")


def zip_strict(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows side by side by their key; a key that one side lacks or repeats is an error."""
    mark = lambda df, name: df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key)))
    both = mark(left, "_l").join(mark(right, "_r"), key, "full")
    sure = F.when((F.col("_l") == 1) & (F.col("_r") == 1), F.col(key)).otherwise(F.raise_error(F.lit("the sides do not match")).cast(left.schema[key].dataType))
    return both.withColumn(key, sure).drop("_l", "_r")

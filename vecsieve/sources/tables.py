"""Scans, keyed stores and checks of files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checked(df: DataFrame, expected: int | None) -> DataFrame:
    """The frame, if it has the expected number of rows."""
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} rows where {expected} were expected")
    return df


def image_paths(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths of files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path")


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files, "path", "left_anti")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", F.sha2("content", 256).alias("sha256"))


def unverified(digests: DataFrame, pins: DataFrame) -> DataFrame:
    """Files whose digest is not the pinned one, or that have no pin."""
    return digests.join(pins.withColumnRenamed("sha256", "pinned"), "path", "left").filter("pinned is null or pinned != sha256")


def key_differences(expected: DataFrame, found: DataFrame, allowed: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``(key, problem)``: keys missing, but for allowed endings and prefixes, and keys unexpected."""
    gone = expected.select("key").exceptAll(found.select("key"))
    for suffix in allowed:
        gone = gone.filter(~F.col("key").endswith(suffix))
    for prefix in prefixes:
        gone = gone.filter(~F.col("key").startswith(prefix))
    extra = found.select("key").exceptAll(expected.select("key"))
    return gone.withColumn("problem", F.lit("missing")).unionByName(extra.withColumn("problem", F.lit("unexpected")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def found(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class Store:
    """Tables kept under a key; a table is made once, and a hit does not touch its inputs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, **key: object) -> str:
        return "/".join([self.root, kind, *(f"{k}={v}" for k, v in sorted(key.items()))])

    def get(self, kind: str, make: Callable[[], DataFrame], **key: object) -> DataFrame:
        path = self.path(kind, **key)
        if not exists(self.spark, path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def index(self, kind: str) -> DataFrame:
        """All tables of a kind with their keys as columns; ``sample`` is 0 where older tables lack it."""
        out = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{kind}")
        return out.withColumn("sample", F.coalesce("sample", F.lit(0))) if "sample" in out.columns else out.withColumn("sample", F.lit(0))


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """Canonical JSON state, replaced as a whole."""
    spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])

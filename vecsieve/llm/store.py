"""Shared storage and keys for the training-data operators.

Executors and the driver share only the folder named by ``spark.checkpoint.dir``;
every cut of a lineage is a Parquet table there, so a lost executor costs only its
running tasks.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, the warehouse, or a temporary folder if all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        folder = spark.conf.get("spark.sql.warehouse.dir")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="vecsieve-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Cuts:
    """Tables written to cut lineage.

    ``drop`` removes those that no later plan reads. Spark deletes the shuffle files of a
    finished plan when the driver collects its garbage, so ``drop`` asks for that as well.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/vecsieve-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []
        self.renumbered = False
        atexit.register(self._sweep)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for held, path in self.paths:
            if any(held is df for df in frames):
                _delete(self.spark, path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _sweep(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may be gone at exit
            return


def keyed(cuts: Cuts, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(uid, id, text)``; ``uid`` is unique per row and ordered as the ids are.

    Ids that are unique and not null are the uids. Otherwise rows are sorted by (id, text),
    nulls first, over the cluster, and numbered, so that every row stays a document of its own.
    """
    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    odd = two.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("id").isNull())
    if odd.isEmpty():
        return two.select(F.col("id").alias("uid"), "id", "text")
    cuts.renumbered = True
    numbered = two.orderBy(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn("uid", F.monotonically_increasing_id())
    return cuts.cut(numbered.select("uid", "id", "text"))


def restore_id(cuts: Cuts, out: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """The id column of a result that is keyed by uid; ids that are the uids need no join."""
    if not cuts.renumbered:
        return out.withColumnRenamed("uid", id_col)
    return out.join(rows.select("uid", F.col("id").alias(id_col)), "uid").drop("uid")

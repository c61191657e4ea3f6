"""Session set-up shared by the command line, the bench and the driver contract."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    paths = [ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
    return spark


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vecsieve")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return share_code(spark)

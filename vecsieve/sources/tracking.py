"""A derived store of runs, replayed from the run log: disposable, and never a reason for a run to fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import run_name, shown_params
from . import runlog

STORE = "run string, config map<string,string>, metrics map<string,double>"


def names(records: DataFrame) -> DataFrame:
    """``run``: technique, dataset and parameters in order of their keys, joined by dashes."""
    return records.withColumn("run", run_name(F.col("technique"), F.col("dataset"), shown_params(F.col("params"))))


def tracked(records: DataFrame) -> DataFrame:
    """``(run, config, metrics)`` of each record."""
    return runlog.flatten_metrics(runlog.config_of(names(records))).select("run", "config", "metrics")


def replay(records: DataFrame, path: str | None) -> int:
    """Write all records to the store anew; their number, or 0 without a store or where it cannot be written."""
    if path is None:
        return 0
    try:
        tracked(records).write.mode("overwrite").parquet(path)
        return records.sparkSession.read.parquet(path).count()
    except Exception as e:
        print(f"not tracked: {e}".splitlines()[0])
        return 0


def curves(points: DataFrame, metric: str = "val/mean_average_precision") -> DataFrame:
    """``(run, step, value)`` of points ``(run, step, metrics)`` whose JSON text holds the metric."""
    value = F.get_json_object("metrics", f"$['{metric}']").try_cast("double")
    return points.select("run", "step", value.alias("value")).filter("value is not null")


def last_points(curve: DataFrame) -> DataFrame:
    return curve.groupBy("run").agg(F.max("step").alias("step"), F.max_by("value", "step").alias("value"))

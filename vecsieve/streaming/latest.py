"""Structured Streaming extensions of the run log: the latest record per key, progress heartbeats."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_by_key(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """State of one row per key: the one with the greatest ``seq``."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.col(seq)).alias("last")
    return rows.groupBy(*key).agg(best).select(*key, "last.*")


def windowed_counts(rows: DataFrame, ts: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per tumbling window with a watermark (an extension)."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(frame: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that the source has now, in a table in memory of that name: for results of a bounded size."""
    writer = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


class Heartbeat(StreamingQueryListener):
    """Time of the last progress; a query without any for ``limit`` seconds is stalled."""

    def __init__(self, limit: float = 900.0):
        self.limit, self.last = limit, time.time()

    def onQueryStarted(self, event) -> None:
        self.last = time.time()

    def onQueryProgress(self, event) -> None:
        self.last = time.time()

    def onQueryIdle(self, event) -> None:
        self.last = time.time()

    def onQueryTerminated(self, event) -> None:
        self.last = time.time()

    def stalled(self) -> bool:
        return time.time() - self.last > self.limit

"""Incremental extraction as a stream: only files whose digest is new are passed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed_files(files: DataFrame) -> DataFrame:
    """The stream's files (path, text, ts) once for each distinct (path, digest) within an hour of event time."""
    keyed = files.withColumn("sha256", F.sha2("text", 256)).withWatermark("ts", "1 hour")
    return keyed.dropDuplicatesWithinWatermark(["path", "sha256"])


def windowed_changes(files: DataFrame, window: str = "10 minutes") -> DataFrame:
    """path's folder and window with the number of changes, late ones within the watermark counted in."""
    return changed_files(files).groupBy(F.window("ts", window), F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("changes"))


def keep_index(files: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `write` (which must be idempotent for a batch number) on each batch of changed files that is there now."""
    return changed_files(files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

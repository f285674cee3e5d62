"""Cut lineage: tables written to the folder that all executors share; rows dealt over the tasks of a session."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where a local session sets none (tests); on a cluster one must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        found = spark.sparkContext.getCheckpointDir() or made
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once and read back; the shuffles that made them go, so that rounds do not pile theirs up."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes a table that cut wrote and nothing reads any more."""
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(table._cut_at)
    path.getFileSystem(conf).delete(path, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys over as many tasks as a shuffle has, two a core at least: thousands of short texts may
    stand in one split of an input, and one task would read them all."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)

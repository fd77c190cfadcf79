"""Cutting lineage in the shared checkpoint folder, and checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast if it has at most this many rows; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share. Only in local mode, as in tests, may it be
    unset; a temporary folder then takes its place."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="shared-")


#: Spark's setting (from 4.1 on) by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder, so a lost executor costs no recomputation.

    The shuffle files that made them go at once, as nothing reads them any more; else they stay until the
    driver happens to collect its garbage, and loops of many rounds fill the disks."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own: df's, which a caller may run again, keeps its files
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    return f"{shared_folder(spark)}/{name}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Runs the fetch jobs of a set of layers: what is landed is skipped, what fails is told and the rest goes on."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.sources import snapshots

LOG = "name string, state string, n_features long, error string"


def landed(spark: SparkSession, path: str) -> bool:
    """Whether a layer has a version that counts, which is written whole before it does; any file system that Spark reads will do."""
    return snapshots.current(spark, path) is not None


def layer(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a layer as last fetched whole."""
    return snapshots.read_table(spark, f"{folder.rstrip('/')}/{name}")


def fetch_all(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]], folder: str, refresh: bool = False, at_once: int = 4) -> DataFrame:
    """One row for each job: cached, fetched (and how many features) or failed (and why).

    A job gives a DataFrame, whose pages are read in parallel; `at_once` jobs run side by side. A layer is written beside its old
    version and takes its place in one step, so a failed refresh keeps what was there. The jobs are few: only names and counts
    pass the driver.
    """

    def run(name: str) -> tuple:
        path = f"{folder.rstrip('/')}/{name}"
        if not refresh and landed(spark, path):
            return name, "cached", None, None
        try:
            return name, "fetched", snapshots.write_table(jobs[name](), path), None
        except Exception as error:  # a source may fail in any way; the others still run
            return name, "failed", None, str(error).splitlines()[0][:500] if str(error) else type(error).__name__

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        log = list(pool.map(run, jobs))
    return spark.createDataFrame(log, LOG)


def provenance(log: DataFrame, source: str) -> DataFrame:
    """value: a JSON record of each layer fetched, for the sidecar of its folder."""
    held = F.struct("name", "n_features", F.lit(source).alias("source"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved"))
    return log.where("state = 'fetched'").select(F.to_json(held).alias("value"))


def newest_stamp(text: str) -> int:
    """The format stamp in a snapshot's JSON, 0 unless it is a whole number."""
    try:
        value = json.loads(text).get("format", 0)
    except (ValueError, AttributeError):
        return 0
    return value if type(value) is int else 0

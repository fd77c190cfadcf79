"""Streets kept by tile: a folder for each tile and a manifest, read by box or along a line without touching other tiles.

A box becomes a filter on the folders' keys, which is settled when the query is planned. Keys that are only known at run time, such as those
along a route, are joined; the scan then waits for them and opens their folders alone (dynamic partition pruning). Tiles that a
client has already are left out of the keys, so driving on along a corridor reads what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators import cells
from kerbline.plans.lineage import cut, small

KEY = ["tile_col", "tile_row"]
FAR = (1 << 31) - 1  # no tile lies beyond


def write(tiled: DataFrame, folder: str) -> None:
    """tiled: rows with tile_col and tile_row (cells.assign_tiles)."""
    cells.write_tiles(tiled, f"{folder}/tiles")
    tiled.groupBy(*KEY).agg(F.count("*").alias("n_edges")).write.mode("overwrite").parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """tile_col, tile_row, n_edges of every tile there is."""
    return spark.read.parquet(f"{folder}/manifest")


def in_box(spark: SparkSession, folder: str, lon0: float, lat0: float, lon1: float, lat1: float, margin: int = 0) -> DataFrame:
    """The streets of the tiles in a box."""
    return cells.tiles_in_box(spark.read.parquet(f"{folder}/tiles"), lon0, lat0, lon1, lat1, margin)


def missing(spark: SparkSession, folder: str, keys: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """The keys (tile_col, tile_row) that the manifest has and that are not loaded yet, each once."""
    wanted = keys.select(*(F.col(c).cast("bigint").alias(c) for c in KEY)).distinct().join(manifest(spark, folder).select(*KEY), KEY, "left_semi")
    return wanted if loaded is None else wanted.join(loaded.select(*KEY), KEY, "left_anti")


def along(spark: SparkSession, folder: str, points: DataFrame, margin: int = 1, loaded: DataFrame | None = None) -> DataFrame:
    """The streets of the tiles within a margin of the points (lon, lat), but for those loaded already."""
    keys = missing(spark, folder, cells.corridor_keys(points, margin), loaded)
    streets = spark.read.parquet(f"{folder}/tiles")
    types = dict(streets.dtypes)
    # The bound holds for every tile; the optimizer prunes a scan only by a side that some filter narrows, and by equal types.
    keys = cut(keys.select(*(F.col(c).cast(types[c]).alias(c) for c in KEY))).where((F.col("tile_col") < FAR) & (F.col("tile_row") < FAR))
    return streets.join(small(keys), KEY)

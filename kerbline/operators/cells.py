"""Grids and tiles: sampling lines, heat cells, tile assignment, local ids and tile keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions.geo import cell, num, slippy_tile
from kerbline.operators.projects import numbered

SAMPLE_M = 35.0
#: Parts of a metre: a multiple of all numbers up to 16 and of a million, so shares of streets are whole parts.
PARTS = 720720 * 10**6


def sample_lines(lines: DataFrame) -> DataFrame:
    """Lines (alon, alat, blon, blat, length) as points lon, lat about every 35 m, each standing for m metres."""
    n = F.greatest(F.lit(1), F.bround(F.col("length") / SAMPLE_M).cast("int"))
    out = lines.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = (F.col("_i") + num(0.5)) / F.col("_n")
    return out.select(*lines.columns, (F.col("length") / F.col("_n")).alias("m"), (F.col("alon") + (F.col("blon") - F.col("alon")) * t).alias("lon"), (F.col("alat") + (F.col("blat") - F.col("alat")) * t).alias("lat"))


def stress_heat(samples: DataFrame, least_m: float = 30.0) -> DataFrame:
    """Metre-weighted stress of every cell (col, row) with enough street, in three bands: whole parts of metres by whole
    millionths of stress, so the sums are exact and a mean at a half rounds alike in any order of the samples."""
    parts = F.round(F.col("m") * num(PARTS)).cast("decimal(20,0)")
    stress = F.round(F.col("stress") * num(1e6)).cast("decimal(14,0)")
    per = samples.groupBy("col", "row").agg(F.sum(parts).alias("m"), F.sum(parts * stress).alias("s")).where(F.col("m") >= F.lit(round(least_m * PARTS)))
    metres = F.col("m").cast("double") / PARTS
    mean = (F.col("s") / 10**6).cast("double") / PARTS / metres
    at_most = lambda top: F.col("s") <= F.col("m") * F.lit(top * 10**6)
    thousandths = lambda c: F.round(c * 1000) / 1000
    return per.select("col", "row", thousandths(metres).alias("metres"), thousandths(mean).alias("stress"), F.when(at_most(2), "low").when(at_most(5), "medium").otherwise("high").alias("band"))


def lane_heat(samples: DataFrame, least_m: float = 20.0) -> DataFrame:
    """Metres of facilities and of protected ones in every cell."""
    lanes = samples.where(F.col("cls").isin("path", "separated", "buffered", "lane"))
    safe = F.sum(F.when(F.col("cls").isin(*dims.PROTECTED), F.col("m")).otherwise(num(0)))
    per = lanes.groupBy("col", "row").agg(F.sum("m").alias("m"), safe.alias("p")).where(F.col("m") >= least_m)
    return per.select("col", "row", F.round("m", 3).alias("facility_m"), F.round("p", 3).alias("protected_m"), F.when(F.col("p") >= F.col("m") * 0.5, "protected").when(F.col("p") > 0, "mixed").otherwise("painted").alias("band"))


def elevation_bands(points: DataFrame) -> DataFrame:
    """Mean elevation of every cell in six bands."""
    mean = F.avg("elev")
    band = F.when(F.col("mean") < 5, 0)
    for i, top in enumerate((15, 25, 35, 45), 1):
        band = band.when(F.col("mean") < top, i)
    return points.groupBy("col", "row").agg(mean.alias("mean")).select("col", "row", F.round("mean", 3).alias("mean_m"), band.otherwise(5).alias("band"))


def assign_tiles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the one tile (tile_col, tile_row) that their midpoint lies in."""
    at = nodes.select("id", "lon", "lat")
    e = edges.join(at.select(F.col("id").alias("u"), F.col("lon").alias("_alon"), F.col("lat").alias("_alat")), "u").join(at.select(F.col("id").alias("v"), F.col("lon").alias("_blon"), F.col("lat").alias("_blat")), "v")
    col = cell((F.col("_alon") + F.col("_blon")) / 2, dims.TILE_LON0, dims.TILE_DEG)
    row = cell((F.col("_alat") + F.col("_blat")) / 2, dims.TILE_LAT0, dims.TILE_DEG)
    return e.select(*edges.columns, col.alias("tile_col"), row.alias("tile_row"))


def local_ids(tiled: DataFrame) -> DataFrame:
    """gid and local_id of the nodes of every tile, by ascending global id."""
    ends = tiled.select("tile_col", "tile_row", F.explode(F.array("u", "v")).alias("gid")).distinct()
    w = Window.partitionBy("tile_col", "tile_row").orderBy("gid")
    return ends.withColumn("local_id", F.dense_rank().over(w).cast("bigint") - 1)


def tiles_in_box(tiles: DataFrame, lon0: float, lat0: float, lon1: float, lat1: float, margin: int = 0) -> DataFrame:
    key = lambda v, origin: cell(num(v), origin, dims.TILE_DEG)
    cols = F.col("tile_col").between(key(lon0, dims.TILE_LON0) - margin, key(lon1, dims.TILE_LON0) + margin)
    rows = F.col("tile_row").between(key(lat0, dims.TILE_LAT0) - margin, key(lat1, dims.TILE_LAT0) + margin)
    return tiles.where(cols & rows)


def corridor_keys(points: DataFrame, margin: int = 1) -> DataFrame:
    """Tile keys within a margin of any point of a line; join them to prune partitions."""
    spread = F.array(*map(F.lit, range(-margin, margin + 1)))
    keys = points.select(cell(F.col("lon"), dims.TILE_LON0, dims.TILE_DEG).alias("c"), cell(F.col("lat"), dims.TILE_LAT0, dims.TILE_DEG).alias("r")).distinct()
    keys = keys.withColumn("dx", F.explode(spread)).withColumn("dy", F.explode(spread))
    return keys.select((F.col("c") + F.col("dx")).alias("tile_col"), (F.col("r") + F.col("dy")).alias("tile_row")).distinct()


def basemap_keys(points: DataFrame, zooms: tuple[int, ...] = (13, 14, 15, 16)) -> DataFrame:
    """Distinct web map tiles of points at several zooms."""
    z = points.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms))))
    x, y = slippy_tile(F.col("lon"), F.col("lat"), F.col("zoom"))
    return z.select("zoom", x.alias("x"), y.alias("y")).distinct()


def dictionary_encoded(edges: DataFrame) -> DataFrame:
    """Names and classes as ids in alphabetical order, by joining small dictionaries rather than ranking all rows."""
    names = edges.select(F.coalesce("name", F.lit("")).alias("label")).distinct()
    classes = edges.select(F.col("cls").alias("label")).distinct()
    number = lambda d, out: numbered(d, [F.col("label")], out).withColumn(out, F.col(out).cast("bigint") - 1)
    e = edges.withColumn("_name", F.coalesce("name", F.lit("")))
    e = e.join(number(names, "name_id").withColumnRenamed("label", "_name"), "_name").join(number(classes, "class_id").withColumnRenamed("label", "cls"), "cls")
    return e.select("u", "v", "name_id", "class_id", F.round("length", 1).alias("length"))


def write_tiles(tiled: DataFrame, path: str) -> None:
    """One partition folder for each tile; readers prune by joining or filtering on the tile key."""
    tiled.repartition("tile_col", "tile_row").write.mode("overwrite").partitionBy("tile_col", "tile_row").parquet(path)

"""Landed files: feature collections, networks, pixel tiles and the record of what was fetched."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.geo import state_plane
from kerbline.sources import png

FEATURES = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """geometry (type, coordinates as JSON text) and properties of a feature collection; no rows if it is missing."""
    empty = spark.createDataFrame([], "geometry struct<type:string,coordinates:string>, properties map<string,string>")
    try:
        raw = spark.read.schema(FEATURES).option("multiLine", "true").json(path)
        return raw.select(F.explode("features").alias("f")).select("f.geometry", "f.properties")
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty


def points(rows: DataFrame) -> DataFrame:
    """Point features with lon, lat and metres east and north of the state plane."""
    c = F.from_json("geometry.coordinates", "array<double>")
    at = rows.where("geometry.type = 'Point'").withColumns({"lon": c[0], "lat": c[1]})
    east, north = state_plane(F.col("lon"), F.col("lat"))
    return at.withColumns({"x": east, "y": north})


def rings(rows: DataFrame) -> DataFrame:
    """Polygons and multipolygons with `rings`: their outer rings of at least four points, as arrays of (x, y)."""
    polygon = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("geometry.type") == "Polygon", F.array(polygon)).when(F.col("geometry.type") == "MultiPolygon", many)
    outer = F.transform(parts, lambda p: F.transform(p[0], lambda q: F.struct(F.round(q[0], 5).alias("x"), F.round(q[1], 5).alias("y"))))
    return rows.where(parts.isNotNull()).withColumn("rings", F.filter(outer, lambda r: F.size(r) >= 4))


def segments(rows: DataFrame) -> DataFrame:
    """Lines as straight segments ax, ay, bx, by in metres, with the row's properties and a number."""
    line = F.from_json("geometry.coordinates", "array<array<double>>")
    many = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("geometry.type") == "LineString", F.array(line)).when(F.col("geometry.type") == "MultiLineString", many)
    pair = F.transform(parts, lambda l: F.zip_with(F.slice(l, 1, F.size(l) - 1), F.slice(l, 2, F.size(l) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    each = rows.where(parts.isNotNull()).select("properties", F.posexplode(F.flatten(pair)).alias("n", "s"))
    (ax, ay), (bx, by) = state_plane(F.col("s.a")[0], F.col("s.a")[1]), state_plane(F.col("s.b")[0], F.col("s.b")[1])
    return each.select("properties", "n", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


def network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a network written by sinks.write_network."""
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def newest(spark: SparkSession, bundled: str, remote: str | None, built: str = "built") -> DataFrame:
    """The snapshot whose build date is later; the bundled one on a tie or where the other cannot be read."""
    here = spark.read.parquet(bundled)
    if remote is None:
        return here
    try:
        there = spark.read.parquet(remote)
        a, b = (d.agg(F.max(built)).first()[0] for d in (here, there))
    except AnalysisException:
        return here
    return there if b is not None and (a is None or str(b) > str(a)) else here


def pixels(spark: SparkSession, path: str, pattern: str = r"(\d+)/(\d+)\.png$") -> DataFrame:
    """tile_x, tile_y, px, py, r, g, b of PNG tiles named .../x/y.png. Unreadable files have no pixels."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", pattern, 1).cast("long").alias("tile_x"), F.regexp_extract("path", pattern, 2).cast("long").alias("tile_y"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y, content in batch.itertuples(index=False):
                try:
                    image = png.rgb(bytes(content)).astype("int32")
                except (ValueError, zlib.error, struct.error):
                    continue
                py, px = np.divmod(np.arange(image.shape[0] * image.shape[1]), image.shape[1])
                flat = image.reshape(-1, 3)
                yield pd.DataFrame({"tile_x": x, "tile_y": y, "px": px.astype("int32"), "py": py.astype("int32"), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return files.mapInPandas(decode, "tile_x long, tile_y long, px int, py int, r int, g int, b int")

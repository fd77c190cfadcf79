"""What is written: networks, tiles, feature collections, ranked tables and the record of each run."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.cells import write_tiles

__all__ = ["cell_ring", "line_features", "polygon_features", "write_collection", "write_csv", "write_features", "write_log", "write_network", "write_tiles"]


def write_network(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def cell_ring(col: Column, row: Column, west: float, south: float, width: float, height: float) -> Column:
    """Coordinates of a grid cell's outline as JSON text, closed, counter-clockwise, to six places."""
    x = lambda c: c * F.lit(width) + F.lit(west)
    y = lambda c: c * F.lit(height) + F.lit(south)
    corners = [(x(col), y(row)), (x(col + 1), y(row)), (x(col + 1), y(row + 1)), (x(col), y(row + 1)), (x(col), y(row))]
    return F.format_string("[[" + ",".join(["[%.6f,%.6f]"] * 5) + "]]", *(c for corner in corners for c in corner))


def _features(rows: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """value: one JSON feature a row; geometry is JSON text, a property without value is written as null."""
    held = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    return rows.select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), held, F.lit("}")).alias("value"))


def line_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """Features of lines: `coords`, an array of (lon, lat), where there is such a column and it isn't null, else the
    straight line alon, alat, blon, blat. Points without a number are left out."""
    straight = [c for c in ("alon", "alat", "blon", "blat") if c in rows.columns]
    ends = F.array(F.struct(F.col("alon").alias("lon"), F.col("alat").alias("lat")), F.struct(F.col("blon").alias("lon"), F.col("blat").alias("lat"))) if len(straight) == 4 else F.array()
    line = F.coalesce("coords", ends) if "coords" in rows.columns else ends
    good = F.filter(line, lambda p: (F.abs(p["lon"]) <= 180) & (F.abs(p["lat"]) <= 90))
    points = F.transform(good, lambda p: F.array(F.round(p["lon"], 6), F.round(p["lat"], 6)))
    return _features(rows, F.to_json(F.struct(F.lit("LineString").alias("type"), points.alias("coordinates"))), properties)


def polygon_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """Features of polygons whose coordinates are JSON text in `ring`."""
    return _features(rows, F.concat(F.lit('{"type":"Polygon","coordinates":'), F.col("ring"), F.lit("}")), properties)


def write_collection(features: DataFrame, path: str) -> None:
    """One FeatureCollection for each partition of features (value): a file each, so nothing is gathered in one task.
    Coalesce to one partition before for a small layer that must be one file."""

    def whole(batches):
        before = '{"type":"FeatureCollection","features":['
        for batch in batches:
            lines = []
            for value in batch["value"]:
                lines.append(before)
                before = value + ","
            yield pd.DataFrame({"value": lines}, dtype=str)
        yield pd.DataFrame({"value": [before.removesuffix(",") + "]}"]})

    features.mapInPandas(whole, "value string").write.mode("overwrite").text(path)


def write_features(rows: DataFrame, properties: list[str], path: str) -> None:
    """Newline-delimited features, one file for each partition: nothing is gathered in one task."""
    line_features(rows, properties).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_log(counts: DataFrame, source: str, path: str) -> None:
    """Appends name, n_features, source and the time to the ingest log."""
    counts.select("name", "n_features", F.lit(source).alias("source"), F.current_timestamp().alias("retrieved")).write.mode("append").parquet(path)

"""Queries on imagery: crops about every node of the derived network, over tiles drawn from the parts that lie in them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators import mosaics
from kerbline.plans import grid
from kerbline.plans.registry import query
from kerbline.sources import png

ZOOM, HALF = 16, 12


def _sites(spark, folder: str) -> DataFrame:
    cx, cy = mosaics.pixel_of(F.col("lon"), F.col("lat"), ZOOM)
    return grid.nodes(spark, folder).select(F.col("id").alias("site"), cx.alias("cx"), cy.alias("cy"))


def image_tiles(spark, folder: str) -> DataFrame:
    """tile_x, tile_y, image: a pattern that depends on how many nodes lie in a tile; every fourth number has no tile."""
    held = _sites(spark, folder).groupBy(F.floor(F.col("cx") / 256).alias("tile_x"), F.floor(F.col("cy") / 256).alias("tile_y")).agg(F.count("*").alias("n")).where("n % 4 <> 0")

    def draw(batches):
        y, x = np.mgrid[:256, :256]
        for batch in batches:
            images = [png.encode(np.stack([x * 3 + y * 5 + n * 11, x * n, y + n * 7], axis=2) % 256) for n in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(images, pa.binary())], ["tile_x", "tile_y", "image"])

    return held.mapInArrow(draw, "tile_x long, tile_y long, image binary")


@query("crop_mosaics", grid.sql(f""", site AS (SELECT id, floor((lon + 180) / 360 * {2**ZOOM * 256})::BIGINT AS cx, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * {2**ZOOM * 256})::BIGINT AS cy FROM node),
tile AS (SELECT cx // 256 AS tx, cy // 256 AS ty, count(*) AS n FROM site GROUP BY 1, 2 HAVING count(*) % 4 <> 0),
px AS (SELECT id, dy * {2 * HALF} + dx AS place, cx - {HALF} + dx AS gx, cy - {HALF} + dy AS gy FROM site, range({2 * HALF}) a(dx), range({2 * HALF}) b(dy)),
seen AS (SELECT id, place, t.n IS NOT NULL AS there, CASE WHEN t.n IS NULL THEN [0, 0, 0] ELSE [(gx % 256 * 3 + gy % 256 * 5 + n * 11) % 256, gx % 256 * n % 256, (gy % 256 + n * 7) % 256] END AS c FROM px LEFT JOIN tile t ON t.tx = gx // 256 AND t.ty = gy // 256),
flat AS (SELECT id, bool_or(there) AS there, flatten(list(c ORDER BY place)) AS bytes FROM seen GROUP BY 1),
polynomial AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS tab)
SELECT id AS site, CASE WHEN there THEN {2 * HALF} END AS width, CASE WHEN there THEN {2 * HALF} END AS height, CASE WHEN there THEN xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) END AS crc FROM flat, polynomial"""))
def crop_mosaics(spark, folder):
    """The crop of 24 by 24 pixels about every node: its size and the CRC of its pixels."""
    return mosaics.crops(_sites(spark, folder), image_tiles(spark, folder), HALF).select("site", "width", "height", "crc")
